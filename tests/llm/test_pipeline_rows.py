"""The pipeline's rows against plain Python and SQL, stage by stage, each on what it was given."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece

import corpus_pipeline
from tallyloom.llm import linerules, mixing, simhash, toxicity
from test_corpus_operators import MODEL, brute_fingerprint, plain_reading, reachable

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def in_sql(sql, rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows)[["doc_id", "text", "source"]])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return {r["doc_id"]: r for r in (dict(zip(names, values)) for values in result.fetchall())}


def not_toxic(rows, model):
    def score(text):
        evidence = np.dot(plain_reading(model, text), model.weights())
        return 1 / (1 + np.exp(-(model.offset + model.slope * np.log1p(evidence))))
    return [r for r in rows if score(r["text"]) < 0.7]


def cleaned(rows):
    """Lines that pass and are no repeats, of the documents that the SQL keeps."""
    verdicts, out = in_sql(linerules.VERDICTS_SQL, rows), []
    for r in rows:
        lines = r["text"].split("\n")
        left = [line for k, line in enumerate(lines) if not line.strip(" \t\v\f\r") or not (
            line in lines[:k] or linerules.line_fails(line, line.encode().split()))]
        if verdicts[r["doc_id"]]["kept"]:
            text = "\n".join(left)
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def first_of_groups(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    roots = reachable([brute_fingerprint(r["text"]) for r in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    return [r for k, r in enumerate(rows) if roots[k] == k]


def dealt(rows):
    mix = in_sql(mixing.MIXTURE_SQL, rows)
    return [r for r in rows for _ in range(mix[r["doc_id"]]["taken"] // max(mix[r["doc_id"]]["size"], 1))]


def digests(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = []
    for r in rows:
        ids = library.encode(r["text"])
        found.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                      hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return found


def test_rows_equal_those_of_plain_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    for plain, (name, apply) in zip((lambda r: not_toxic(r, model), cleaned, first_of_groups, dealt),
                                    corpus_pipeline.STAGES):
        want = plain(rows)
        docs = corpus_pipeline.stage(apply(spark, docs, FOLDER), "plain")
        have = [r.asDict() for r in docs.collect()]
        assert Counter(tuple(r.items()) for r in have) == Counter(tuple(r.items()) for r in want), name
        assert 0 < len(want) and (len(want) < len(rows) or name == "mixing sources"), name
        rows = want
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == Counter(digests(rows))


def test_rows_that_differ_in_where_a_null_stands_are_told_apart(spark):
    rows = [(1, "a b c d e", None, "x"), (1, "a b c d e", "x", None), (1, "a b c d e", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, other = simhash.fingerprints(docs).select("row", "check").distinct().collect()
    assert one["row"] == other["row"] and one["check"] != other["check"]
    assert simhash.kept_documents(docs).count() == 1
