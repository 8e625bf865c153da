"""The whole pipeline against its stages done by brute force, over the small table of nulls, copies and clashing columns."""

import re
import zlib
from collections import Counter

import corpus_pipeline
from leafmill.llm import mixing, pii, quality

from test_documents import WORD, brute_components, brute_spans, brute_statistics, ids_of, tokenizer  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_quality(rows):
    norm = lambda x: re.sub(r"[0-9]+", "0", " ".join(WORD.findall(x.lower())))
    held, hosts = {}, Counter(r[3] or "" for r in rows)
    for _, text, _, host, _ in rows:
        for x in {norm(x) for x in (text or "").split("\n") if WORD.search(x)}:
            held.setdefault((host or "", x), set()).add(norm(text))
    hot = {k for k, v in held.items() if len(v) > quality.LIMIT_DOCUMENTS and 1000 * len(v) > quality.LIMIT_PER_MILLE * hosts[k[0]]}
    out = []
    for doc_id, text, lang, host, _ in rows:
        n, *_, repeats = brute_statistics(text)
        lines = (text or "").split("\n")
        gone = [x for x in lines if (host or "", norm(x)) in hot]
        if n >= 50 and 100 * repeats <= 50 * n and 100 * sum(len(WORD.findall(x)) for x in gone) <= quality.DEPLETED_PERCENT * n:
            out.append((doc_id, "\n".join(x for x in lines if (host or "", norm(x)) not in hot), lang, host))
    return out


def brute_mixed(rows):
    import duckdb
    import pyarrow as pa

    c = duckdb.connect()
    c.register("documents", pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))}))
    times = Counter(c.execute(f"SELECT doc_id, lang, source FROM ({mixing.oracle()})").fetchall())
    return [r for r in rows for _ in range(times[r[0], r[2] or "", r[3] or ""])]


def test_the_pipeline_against_brute_force(spark, rows, documents, tokenizer, tmp_path):  # noqa: F811
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    kept = brute_quality(rows)
    ids = {doc_id for doc_id, _, _, stays in brute_components([(r[0], r[1]) for r in kept]) if stays}
    one_each = [r for r in kept if r[0] in ids]
    clean = [(i, pii.redact(t, brute_spans(t)), lang, source) for i, t, lang, source in one_each]
    want = Counter()
    for i, text, _, _ in brute_mixed(clean):
        all_ids = ids_of(tokenizer, text, 0)
        for at in range(0, len(all_ids), 1024):
            piece = all_ids[at : at + 1024]
            want[i, at, len(piece), zlib.crc32(piece.tobytes()), len(all_ids)] += 1
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert 0 < len(one_each) < len(kept) < len(rows) and any(a[1] != b[1] for a, b in zip(clean, one_each)) == any(brute_spans(r[1]) for r in one_each)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) <= 1024


def test_an_empty_table_passes_through(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
