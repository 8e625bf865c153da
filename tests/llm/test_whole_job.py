"""Operators do the whole job: what a count, a scan or a training round may not leave out."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import lm, pii, quality

from test_models import _counts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


# -- quality

def _least_line(n):
    """A line whose hash is less than that of each of n documents' own lines."""
    own = [f"only document {_letters(i)} has this" for i in range(n)]
    least = min(quality.line_hash(x.encode()) for x in own)
    return own, next(x for k in range(100_000) if quality.line_hash((x := f"all pages share {_letters(k)} here").encode()) < least)


def test_documents_that_share_their_least_line_count_each(spark):
    own, shared = _least_line(30)
    rows = [(i, f"{x}\n{shared}", "en", "s", 0) for i, x in enumerate(own)]
    copied = [f"a copied text {shared}", "with this line"]
    rows += [(100 + i, "\n".join(copied), "en", "s", 0) for i in range(30)]
    rows += rows[:5]  # repeated rows are one document
    df, key = spark.createDataFrame(rows, COLUMNS), lambda x: ("s", quality.line_hash(x.encode()))
    counted = lambda once: {(r["host"], r["line"]): r["n_docs"] for r in quality.hot_lines(df, copies_once=once).collect()}
    assert counted(True) == {key(shared): 30} and counted(False) == {key(shared): 30, key(copied[0]): 30, key(copied[1]): 30}


def test_pages_of_nothing_but_boilerplate_are_rejected(spark):
    lines = [" ".join(f"{name}{_letters(k)}" for k in range(20)) for name in ("menu", "footer", "link")]
    rows = [(i, "\n".join(lines), "en", "s", 0) for i in range(500)] + [(1000 + i, " ".join(f"{_letters(i)}x{_letters(k)}" for k in range(80)), "en", "s", 0) for i in range(100)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert quality.hot_lines(df).count() == 3
    assert {r["doc_id"] for r in quality.assess(df).where("kept").collect()} == set(range(1000, 1100))
    assert quality.filter_documents(df, copies_once=True).count() == 600  # all left to the removal of copies


def test_short_lines_above_the_limit_go(spark):
    rows = [(i, f"Home\nContact us\nonly page {_letters(i)} has this", "en", "s", 0) for i in range(30)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert {(r["n_hot_lines"], r["n_hot_words"]) for r in quality.assess(df).collect()} == {(2, 3)}


# -- personal data

def test_copies_change_no_confidence(spark):
    rows = [(i, f"please write to user{i}@example.com today") for i in range(20)] + [(99, "please write to someone(at)example(dot)com today")]
    rows += [(1000 + i, "please write to them today") for i in range(50)]
    found = {r["doc_id"]: r["n_added"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[99] == 1 and sum(found.values()) == 1


def test_frequent_other_words_and_null_ids(spark):
    rows = [(i, f"write to user{i}@example.com for more") for i in range(20)] + [(None, "write to someone(at)hidden(dot)example for more"), (100, "write to someone(at)hidden(dot)example for more")]
    rows += [(200 + i, "write to them for more") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash")).withColumn("kind", F.lit(1))
    got = [(r["doc_id"], r["spans"]) for r in pii.find(df).where("n_added > 0").collect()]
    assert sorted(got, key=repr) == sorted([(None, "email:9:38"), (100, "email:9:38")], key=repr)
    cleaned = pii.redact_documents(df)
    assert cleaned.columns == df.columns and cleaned.where("doc_id is null").first()["text"] == "write to [EMAIL] for more"


def _planted(n):
    """(rows, hidden spans by doc_id): prose in which identifiers follow a few phrases, a part of them in shapes that the checked patterns miss."""
    import random

    rng, rows, hidden = random.Random(3), [], {}
    common = [f"{a}{b}{c}" for a in ("ma", "ti", "lo", "ren") for b in ("sa", "no", "vel") for c in ("", "ka", "din", "ros")]
    prose = lambda k: " ".join(rng.choice(common) for _ in range(k))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    kinds = {
        "email": ("please write to", lambda: f"{rng.choice(common)}{digits(3)}@{rng.choice(common)}.org", lambda: rng.choice([f"{rng.choice(common)}{digits(2)} at {rng.choice(common)} dot org", f"{rng.choice(common)}{digits(2)}(at){rng.choice(common)}(dot)org"])),
        "phone": ("our phone number is", lambda: f"+49 30 {digits(7)}", lambda: f"(030) 555 {digits(4)}"),
        "ip": ("the login came from host", lambda: f"10.{rng.randrange(256)}.{rng.randrange(256)}.7", lambda: f"fe80::{digits(4)}:ab{digits(2)}:1"),
    }
    for i in range(n):
        text = prose(rng.randrange(5, 60))
        if rng.random() < 0.4:
            kind = rng.choice(sorted(kinds))
            phrase, seen, unseen = kinds[kind]
            text += f" {phrase} "
            if rng.random() < 0.3:
                value = unseen()
                hidden[i] = (kind, len(text), len(text) + len(value))
            else:
                value = seen()
            text += f"{value} {prose(rng.randrange(3, 20))}"
        elif rng.random() < 0.1:
            text += rng.choice([" please write to them or to us ", " our phone number is secret ", f" room {digits(3)} {digits(4)} at noon ", f" at 12:{digits(2)}:{digits(2)} the login came from nowhere "]) + prose(5)
        rows.append((i, text))
    return rows, hidden


def test_planted_identifiers_are_discovered(spark, monkeypatch):
    """Recall and precision of what patterns add, over as many documents as the small test table has; whatever the parts that scans look for."""
    rows, hidden = _planted(1000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    added = lambda: {r["doc_id"]: r["spans"] for r in pii.find(df).where("n_added > 0").collect()}
    first = added()
    right = sum(f"{k}:{a}:{b}" in first.get(i, "").split(",") for i, (k, a, b) in hidden.items())
    n = sum(r["n_added"] for r in pii.find(df).collect())
    assert right >= 0.95 * len(hidden) and right >= 0.95 * n and len(hidden) > 80, (right, len(hidden), n)
    monkeypatch.setattr(pii, "PATTERNS_PER_SCAN", 5)
    monkeypatch.setattr(pii, "PARTIAL_WORDS", 10)
    assert added() == first


def test_candidates_take_linear_time():
    import time

    for part in ("a", "a@", "1", "1 ", "1-", ":", "a.", "((", "a at ", "(1"):
        began = time.time()
        pii.candidates(part * (300_000 // len(part)), [])
        assert time.time() - began < 3, part


# -- language model

def _encoded(spark, texts):
    rows = [(i, False, lm.subwords(lm.words_of((t or "").encode())).astype("<u2").tobytes()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, held_out boolean, ids binary")


def test_counts_come_from_all_training_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "SEQUENCE_IDS", 50)
    monkeypatch.setattr(lm, "CELLS_AT_ONCE", 30)
    texts = [f"{a} {b} {b} {c}" for a in ("red", "green", "blue") for b in ("house", "garden", "river") for c in ("stands", "falls")] * 3
    df, (_, end, _) = _encoded(spark, texts).repartition(3), lm.encoding()
    sequences = [lm.subwords(lm.words_of(t.encode())) for t in texts]
    total, classes, groups, near, joint = _counts(sequences, end)
    words = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    assert (lm.id_counts(lm.word_counts(words)) == total).all()
    order = np.argsort(-total, kind="stable")[: np.count_nonzero(total)]
    column, own_classes, own_groups = lm.context_columns(total)[order], classes[order], groups[order]
    assert (lm.pair_counts(df.select("ids"), int(total.sum()), order, 2 * lm.CONTEXTS, lambda b, a: lm.neighbour_cells(b, a, column), end, "near") == near[order]).all()
    assert (lm.pair_counts(df.select("ids"), int(total.sum()), order, lm.GROUPS + lm.CLASSES, lambda b, a: lm.joint_cells(b, a, own_classes, own_groups), end, "joint") == joint[order]).all()


def test_all_windows_of_every_document_train_once():
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(4)] + ["one line", ""]
    sequences, (_, end, _) = [lm.subwords(lm.words_of(t.encode())) for t in texts], lm.encoding()
    model = lm.assemble(np.ones(end + 1), np.arange(end + 1) % lm.CLASSES, (np.arange(end + 1) % lm.GROUPS).astype(np.uint8), np.zeros((end + 1, lm.GROUPS), np.float32), np.zeros((end + 1, lm.CLASSES), np.float32))
    trainer, goals = lm.Trainer(model, 0.01, 5), []
    step = trainer._step
    trainer._step = lambda windows, goal: (goals.append((goal >= 0).sum()), step(windows, goal))
    for s in sequences:
        trainer.add([s])
    trainer.done()
    assert sum(goals) == sum(map(len, sequences)) and trainer.windows == sum(-(-len(s) // lm.TRAIN_WINDOW) for s in sequences)


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Several rounds of several shards: the same scores from any layout and order of the rows."""
    monkeypatch.setattr(lm, "SHARD_IDS", 900)
    monkeypatch.setattr(lm, "GROWTH", 2)
    texts = [" ".join(f"{a}{(i * k) % 7}" for k, a in enumerate(("red", "green", "blue", "house") * 12)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = ({r["doc_id"]: (r["score"], r["base_score"]) for r in lm.score(x).collect()} for x in (df.coalesce(1), df.orderBy("text").repartition(7)))
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], rtol=1e-4) for k in one)
