"""Mixing sources to target weights: hierarchical token budgets over a domain-language-source tree.

Every node's budget goes to its children by weight. A child that holds fewer tokens than its part (its capacity:
its tokens times the epochs allowed) takes what it has; its shortage goes to its siblings, by weight, up to
their capacities. Only what all siblings together cannot take is missing from the parent, whose own capacity
says so, and so falls to the parent's siblings. Each leaf then takes a prefix, by tokens, of its documents in a seeded
order of their own for each epoch: whole epochs first, then the part of the next one that the budget allows.

DataFrame functions only. A leaf's order is cut into 4096 buckets by the seeded hash; sums of buckets find the one in
which the budget ends, and only that bucket's rows are ordered, so a leaf of any size is never in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, require, staged

#: Selected documents up to this many are broadcast to pick rows; beyond, the join shuffles.
BROADCAST_DOCUMENTS = 300_000
#: Leaves, by epoch, up to this many are broadcast to their documents; beyond, the join shuffles.
BROADCAST_LEAVES = 100_000
LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Budget as a percentage of all tokens, epochs allowed, seed, and whole weights by name (others: 1)."""

    percent: int = 60
    epochs: int = 2
    seed: int = 17
    domains: dict[str, int] = field(default_factory=lambda: {"books": 4, "code": 3, "forum": 2, "web": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 3, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number at the end of its name (none counts as 0), modulo 4."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, ("web", "books", "code", "forum"))), number % 4 + 1)


def _weight(names: dict[str, int], column: str) -> Column:
    weight = F.lit(1)
    for name, w in names.items():
        weight = F.when(F.col(column) == name, w).otherwise(weight)
    return weight.cast("long")


def _divide(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (cap, weight, budget of the parent) with budget their own: filled by weight up to cap.

    In order of cap/weight, a child is full if the rest of the budget, by weight, reaches its cap. The level
    of those that are not full is the greatest of these quotients.
    """
    of_parent = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))  # the root's children: domains
    before = of_parent.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(of_parent) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = children.withColumn("level", level).withColumn("level", F.max("level").over(of_parent))
    return filled.withColumn("budget", F.floor(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).cast("long")).drop("level", "weight")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens)."""
    capped = leaves.withColumn("cap", F.col("tokens") * mix.epochs)
    by_lang = capped.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    by_domain = capped.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    by_domain = by_domain.withColumn("budget", F.floor(total * mix.percent / 100).cast("long")).drop("tokens")
    one = _divide(by_domain.withColumn("weight", _weight(mix.domains, "domain")), [], "domain")
    two = _divide(by_lang.join(one.select("domain", "budget"), "domain").withColumn("weight", _weight(mix.langs, "lang")), ["domain"], "lang")
    three = _divide(capped.join(two.select("domain", "lang", "budget"), ["domain", "lang"]).withColumn("weight", _weight(mix.sources, "source")), ["domain", "lang"], "source")
    return three.select(*LEAF, "tokens", "budget")


def _counted(documents: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens): a row per document; tokens are words."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain_of(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    return rows.groupBy("doc_id", *LEAF).agg(F.sum("n_tokens").alias("n_tokens"))


def select(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The documents taken: doc_id, domain, lang, source, n_tokens, epoch, leaf_budget; a row per document and epoch.

    Null languages and sources are '' in the tree; null texts hold no tokens. Rows that share doc_id,
    language and source are one document. A document is taken in an epoch if the tokens up to and with it are within the
    epoch's part of the budget; ties of the seeded hash go by doc_id. An empty table, or one without tokens, gives no rows.
    """
    mix = mix or Mix()
    require(documents, "doc_id", "text", "lang", "source")
    rows = staged(_counted(documents), "mix-documents")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    parts = staged(
        budgets(leaves, mix).select("*", F.explode(F.sequence(F.lit(0), F.lit(mix.epochs - 1))).alias("epoch"))
        .withColumn("part", F.greatest(F.lit(0), F.least("tokens", F.col("budget") - F.col("epoch") * F.col("tokens")))).where("part > 0"),
        "mix-budgets",
    )
    small = F.broadcast if parts.count() <= BROADCAST_LEAVES else (lambda df: df)
    whole = rows.join(small(parts.where("part = tokens")), LEAF)
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    cut = rows.join(small(parts.where("part < tokens")), LEAF).withColumn("order", order).withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    up_to = Window.partitionBy(*LEAF, "epoch").orderBy("bucket")
    sums = cut.groupBy(*LEAF, "epoch", "part", "bucket").agg(F.sum("n_tokens").alias("held"))
    summed = sums.withColumn("reached", F.sum("held").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
    ends = summed.where("reached > part").groupBy(*LEAF, "epoch").agg(F.min(F.struct("bucket", (F.col("reached") - F.col("held")).alias("before"))).alias("end")).select(*LEAF, "epoch", "end.*")
    placed = cut.join(small(ends.withColumnRenamed("bucket", "end")), [*LEAF, "epoch"])
    running = Window.partitionBy(*LEAF, "epoch", "bucket").orderBy("order", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where("bucket = end").withColumn("run", F.sum("n_tokens").over(running) + F.col("before")).where("run <= part")
    names = ["doc_id", *LEAF, "n_tokens", "epoch", F.col("budget").alias("leaf_budget")]
    return whole.select(*names).unionByName(placed.where("bucket < end").select(*names)).unionByName(last.select(*names))


def mix_documents(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """documents as mixed: each row once per epoch in which its document is taken."""
    taken = staged(select(documents, mix).select("doc_id", "lang", "source"), "mix-taken").groupBy("doc_id", "lang", "source").agg(F.count("*").alias("times"))
    taken = taken.select(*(F.col(c).alias(f"taken_{c}") for c in ("doc_id", "lang", "source")), "times")
    if taken.count() <= BROADCAST_DOCUMENTS:
        taken = F.broadcast(taken)
    on = (
        documents["doc_id"].cast("long").eqNullSafe(taken["taken_doc_id"])
        & (F.coalesce(documents["lang"].cast("string"), F.lit("")) == taken["taken_lang"])
        & (F.coalesce(documents["source"].cast("string"), F.lit("")) == taken["taken_source"])
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), taken["times"]))
    return documents.join(taken, on).select(*(documents[c] for c in documents.columns), copies.alias("_copy")).select(*(F.col(f"`{c}`") for c in documents.columns))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: the default mix of all documents."""
    return select(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CASES = lambda names, column: "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in names.items()) + " ELSE 1 END" if names else "1"


def _level_sql(source: str, parent: str, name: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    before = f"({part} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT * EXCLUDE (level, budget, weight), CAST(floor(least(CAST(cap AS DOUBLE), weight * max(level) OVER ({part}))) AS BIGINT) AS budget FROM (
      SELECT *, (budget - coalesce(sum(cap) OVER {before}, 0)) / (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER {before}, 0)) AS level FROM ({source}))"""


def oracle(mix: Mix | None = None) -> str:
    """DuckDB SQL for op5's rows over the view documents: the same rule, each leaf ordered as a whole."""
    mix = mix or Mix()
    return f"""
    WITH counted AS (
      SELECT doc_id, ['web', 'books', 'code', 'forum'][coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER), 0) % 4 + 1] AS domain,
             coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_tokens
      FROM documents GROUP BY ALL),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST({mix.epochs} * sum(n_tokens) AS BIGINT) AS cap FROM counted GROUP BY ALL),
    langs AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY ALL),
    domains AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap FROM langs GROUP BY ALL),
    one AS ({_level_sql(f"SELECT domain, cap, {_CASES(mix.domains, 'domain')} AS weight, (SELECT CAST(floor(sum(tokens) * {mix.percent} / 100) AS BIGINT) FROM leaves) AS budget FROM domains", "", "domain")}),
    two AS ({_level_sql(f"SELECT l.*, {_CASES(mix.langs, 'lang')} AS weight, budget FROM langs l JOIN one USING (domain)".replace("budget FROM", "one.budget FROM"), "domain", "lang")}),
    three AS ({_level_sql(f"SELECT l.*, {_CASES(mix.sources, 'source')} AS weight, two.budget FROM leaves l JOIN two USING (domain, lang)", "domain, lang", "source")}),
    parts AS (SELECT * FROM (SELECT *, greatest(0, least(tokens, budget - epoch * tokens)) AS part FROM three, (SELECT unnest(range({mix.epochs})) AS epoch)) WHERE part > 0),
    ordered AS (
      SELECT c.doc_id, domain, lang, source, c.n_tokens, epoch, budget, part,
             sum(c.n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{mix.seed}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM counted c JOIN parts USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, budget AS leaf_budget FROM ordered WHERE run <= part"""
