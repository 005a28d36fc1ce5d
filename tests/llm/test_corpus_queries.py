"""Registered corpus queries: against their SQL, and what all of them share."""

import os

import pytest

import corpus_pipeline
import oracle_compare
from tallyloom.llm import mixing, warc
from tallyloom.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = oracle_compare.connect(FOLDER)
    assert oracle_compare.difference(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"op12_whitening"}))
def test_query_has_a_row_for_every_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = QUERIES[name](spark, FOLDER)
    assert found.count() == docs.count()
    assert found.join(docs, "doc_id", "left_anti").isEmpty()


def test_all_operators_and_no_cross_joins(spark):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    for name in sorted(QUERIES):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        if name.startswith(("op2_", "op8_")):
            assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_stages_keep_the_columns_and_drop_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    counts = [docs.count()]
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(apply(spark, docs, FOLDER), f"stage-{k}")
        counts.append(docs.count())
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    assert counts[5] == counts[4] > 0
    assert counts[4] == corpus_pipeline.run(spark, FOLDER).count()


CLASHING = ["_m", "_measures", "_row", "_evidence", "_EVIDENCE_", "_copy", "_cut", "row", "copies", "at"]


def test_stages_on_odd_rows_and_clashing_names(spark):
    good = "\n".join(f"This is line number {k} of a plain text that nobody has any reason to reject." for k in range(4))
    texts = [None, "", good, good, "x " * 30_000, good.replace("plain", "simple")]
    rows = [(k if k != 3 else 2, t, "en", "s" if k % 2 else None, len(t or ""), *map(str, range(len(CLASHING))))
            for k, t in enumerate(texts)] + [(None, good + " More.", "en", "s", 9, *map(str, range(len(CLASHING))))]
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {names}")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert labels.count()
    for name, apply in corpus_pipeline.STAGES[:4]:
        out = apply(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in CLASHING] == list(map(str, range(len(CLASHING)))), name
        assert apply(spark, docs.limit(0), FOLDER).count() == 0


def test_a_mix_that_cannot_be_dealt_is_refused(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    with pytest.raises(ValueError):
        mixing.mixture(docs, share=2.5)


def test_damaged_archives_are_told_not_fatal(spark, folder):
    pages = spark.createDataFrame([(k, f"u{k}", "<p>%d</p>" % k * 40) for k in range(4)],
                                  "page_id long, url string, html string")
    warc.write_archives(pages, f"{folder}/a", chunk_bytes=50, segment_bytes=150)
    lines = spark.read.option("lineSep", warc.CRLF).text(f"{folder}/a").collect()
    text = warc.CRLF.join(r[0] for r in lines) + warc.CRLF
    text = text.replace("WARC-Segment-Number: 2", "WARC-Segment-Number: two", 1)
    text = text.replace("X-Page-ID: 3", "X-Page-ID: three", 1)
    first = text.index("Content-Length: ")
    text = text[:first] + "Content-Length: 9999999999" + text[text.index(warc.CRLF, first):]
    with open(f"{folder}/b.warc", "w", newline="") as out:
        out.write(text)
    read = warc.read_archives(spark, f"{folder}/b.warc").collect()
    assert 0 < sum(r["verified"] for r in read) < len(read) <= 4


@pytest.mark.parametrize("data, want", [
    (b"3\r\nabc\r\n0\r\n\r\n", b"abc"), (b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n", b"abc"), (b"0\r\n\r\n", b""),
    (b"+3\r\nabc\r\n0\r\n\r\n", None), (b"0x3\r\nabc\r\n0\r\n\r\n", None), (b"1_0\r\n" + b"a" * 16 + b"\r\n0\r\n\r\n", None),
    (b"3\r\nabc\r\n0\r\n", None), (b"3\r\nabc0\r\n\r\n", None), (b"", None),
])
def test_chunks(data, want):
    assert warc.decode_chunks(data) == want
