"""Text layout: runs in content order to lines and words, as columns. Two forms with equal results.

A run more than 5 units above or below its predecessor begins a line. Otherwise a space goes between them if the gap is wide
for the font size and spacing; how wide depends on whether either run is a single character, and a letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = "[a-zA-ZäöåÄÖÅ]"
LINE_STEP = 5.0
DEFAULT_SIZE = 12.0
UNIT_WIDTH = 5.0


def run_end(run) -> Column:
    """Where a run ends; without a width, every character counts 5 units."""
    return run["x"] + F.coalesce(run["width"], F.length(run["text"]) * F.lit(UNIT_WIDTH))


def separator(run, before) -> Column:
    """What goes between a run and its predecessor: nothing, a space, or a line break. before is null for the first run."""
    gap = run["x"] - run_end(before)
    size = F.coalesce(F.nullif(run["font_size"], F.lit(0.0)), F.lit(DEFAULT_SIZE))
    zero = F.lit(0.0)
    tc, tw = F.coalesce(run["char_spacing"], zero), F.coalesce(run["word_spacing"], zero)
    one, last_one = F.length(run["text"]) == 1, F.length(before["text"]) == 1
    letter, last_letter = run["text"].rlike(LETTER), before["text"].rlike(LETTER)
    close = gap < size * 0.5
    both = ~(letter & last_letter & close) & (gap > F.greatest(tw * 0.8, size * 0.7, tc * 6, size * 0.4))
    single = F.when(last_one, last_letter).otherwise(letter)
    mixed = ~(single & close) & (gap > F.greatest(tw * 0.8, size * 0.6, tc * 5))
    words = gap > F.greatest(tc * 1.2, tw * 0.5, size * 0.2)
    space = F.when(one & last_one, both).when(one | last_one, mixed).otherwise(words)
    return F.when(F.abs(run["y"] - before["y"]) > LINE_STEP, F.lit("\n")).when((run_end(before) > 0) & space, F.lit(" ")).otherwise(F.lit(""))


def layout_runs(runs: Column) -> Column:
    """The text of an array of runs, within the row: no shuffle."""
    piece = lambda r, i: F.when(i == 0, r["text"]).otherwise(F.concat(separator(r, F.get(runs, i - 1)), r["text"]))
    return F.array_join(F.transform(runs, piece), "")


def layout_table(runs: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The same over a table of runs (a row each): keys and text."""
    w = Window.partitionBy(*keys).orderBy(order)
    names = ("text", "x", "y", "width", "font_size", "char_spacing", "word_spacing")
    run = {n: F.col(n) for n in names}
    before = {n: F.col(f"before_{n}") for n in ("text", "x", "y", "width")}
    lagged = runs.select(*keys, order, *names, *(F.lag(n).over(w).alias(f"before_{n}") for n in before), F.row_number().over(w).alias("place"))
    pieces = lagged.select(*keys, order, F.when(F.col("place") == 1, F.col("text")).otherwise(F.concat(separator(run, before), F.col("text"))).alias("piece"))
    return pieces.groupBy(*keys).agg(F.expr(f"listagg(piece, '') WITHIN GROUP (ORDER BY {order})").alias("text"))


def sorted_runs(runs: Column) -> Column:
    """Runs in reading order instead: by line from the top (half a font size is one line), then from the left."""
    line = lambda r: F.round(-r["y"] / F.greatest(F.coalesce(r["font_size"], F.lit(DEFAULT_SIZE)) * 0.5, F.lit(0.5)))
    keyed = F.transform(runs, lambda r, i: F.struct(line(r).alias("line"), r["x"].alias("x"), i.alias("i"), r.alias("run")))
    return F.transform(F.array_sort(keyed), lambda k: k["run"])
