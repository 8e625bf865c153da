"""Small tables with what real ones hold: nulls, empty and long texts, copies, clashing extra columns."""

import random

import pytest

CLASHING = ("host", "line", "row", "n", "node", "label", "rank", "bucket", "uid", "times", "found", "kept", "word", "value", "taken_doc_id", "dropped_id", "order", "epoch")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def document_rows():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        text = "\n".join(words(rng, rng.randrange(12, 40)) for _ in range(rng.randrange(2, 8)))
        if i % 3 == 0:
            text += "\nThis line is on every third page of the site."
        rows.append([i, text, ("en", "de")[i % 2], f"src{i % 3}", len(text)])
    for i in range(120, 150):  # near copies, some of them only like others of the group
        parts = rows[7][1].split(" ")
        for _ in range(rng.randrange(1, 6)):
            parts[rng.randrange(len(parts))] = f"x{i}"
        rows.append([i, " ".join(parts), "en", "src1", None])
    rows += [[150 + i, rows[3][1].upper() if i % 2 else rows[3][1], "en", "src0", None] for i in range(10)]  # equal but for case
    rows += [[160, None, None, None, None], [161, "", "en", "src0", 0], [162, " \n\t ", "en", "src0", 4], [163, "two words", "en", None, None], [164, "two words", None, "src9", None]]
    rows += [[165, words(rng, 30_000, 9000), "en", "src2", None], [166, "word " * 300, "en", "src2", None]]
    rows += [[8, rows[8][1], rows[8][2], rows[8][3], None], [None, rows[9][1], "en", "src0", None]]  # a repeated row, a null id
    rows += [[167, "mail a.b@x.example.com or c@d.org_e@f.gh, call +1 (476) 555-6291, ip 10.0.0.1.2.3.4.5 300.1.1.1, card 4699065906345690 4111 1111 1111 1111.", "en", "src1", None]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def documents(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, COLUMNS)
    return df.select("*", *(F.lit(c).alias(c) for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
