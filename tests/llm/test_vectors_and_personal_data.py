"""Whitening, centroid clustering and personal data, each against a plain version."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import centroids, pii, whitening
from tallyloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, component int, cluster int, x string"
TEXTS = "doc_id long, text string, row string, value string, n_email string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, -1, -1, "own") for i, v in rows], VECTORS)


def odd_vectors(size, seed):
    draw = random.Random(seed)
    rows = [(i, [draw.uniform(-2, 2) for _ in range(size)]) for i in range(40)]
    rows += [(40, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (41, None), (42, []),
             (43, [None] * size), (44, [float("nan")] * size), (45, [float("inf")] * size)]
    return rows


def usable(rows, size):
    return [(i, v) for i, v in rows if v is not None and len(v) == size
            and all(c is not None and math.isfinite(c) for c in v)]


def whole(v, scale=64, shift=0):
    return [math.floor(scale * float(np.float32(c))) + shift for c in v]


# ---- whitening


def plain_whitening(rows):
    x = [whole(v, 64, 1_000_000) for _, v in rows]
    n, size = len(x), len(x[0])
    total = [sum(r[d] for r in x) for d in range(size)]
    w = [[n * r[d] - total[d] for d in range(size)] for r in x]
    cov = np.array([[float(Fraction(sum(r[a] * r[b] for r in w), n ** 3)) for b in range(size)]
                    for a in range(size)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    white = np.array(w, float) / n @ axes / np.sqrt(values)
    return n, [sum(c * c for c in r) for r in w], values, white


def test_whitening_equals_the_plain_one(spark):
    rows = odd_vectors(6, 1)
    found = whitening.whitened(vectors(spark, rows)).collect()
    kept = usable(rows, 6)
    n, deviation, values, white = plain_whitening(kept)
    assert len(found) == 6 * n and {r["n"] for r in found} == {n}
    ids = [i for i, _ in kept]
    assert sorted(int(r["deviation"]) for r in found if r["component"] == 1) == sorted(deviation)
    for k in range(6):
        mine = {(r["vec_id"], round(abs(r["whitened"]), 9)) for r in found if r["component"] == k + 1}
        assert mine == {(i, round(abs(white[j, k]), 9)) for j, i in enumerate(ids)}
        signs = {np.sign(r["whitened"] * white[ids.index(r["vec_id"]), k]) for r in found
                 if r["component"] == k + 1}
        assert len(signs) == 1
        share = {r["explained"] for r in found if r["component"] == k + 1}
        assert len(share) == 1 and share.pop() == pytest.approx(values[k] / values.sum(), rel=1e-12)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_whitening_of_wide_numbers_is_exact(spark):
    rows = [(i, [2.0 ** 40 * c, -2.0 ** 41 * (c * c % 7)]) for i, c in enumerate(range(-9, 9))]
    found = whitening.whitened(vectors(spark, rows)).collect()
    n, deviation, values, white = plain_whitening(rows)
    assert [int(r["deviation"]) for r in sorted(found) if r["component"] == 1] == deviation
    assert {round(r["explained"], 12) for r in found} == {round(v / values.sum(), 12) for v in values}


def test_whitening_where_little_varies(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None), (2, [None])])).count() == 0
    one = whitening.whitened(vectors(spark, [(7, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["whitened"], r["explained"], r["identity_error"], int(r["deviation"]))
            for r in one] == [(7, None, None, None, 0)] * 2
    flat = whitening.whitened(vectors(spark, [(1, [1.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert {(r["vec_id"], r["component"]): r["whitened"] for r in flat} == {
        (1, 1): -1.0, (2, 1): 1.0, (1, 2): None, (2, 2): None}
    two = whitening.whitened(vectors(spark, [(1, [1.0]), (2, [3.0]), (3, [1.0, 2.0])])).collect()
    assert {(r["vec_id"], r["n"]) for r in two} == {(1, 2), (2, 2), (3, 1)}


def test_whitening_query(spark):
    found = QUERIES["op12_whitening"](spark, FOLDER)
    assert dict(found.dtypes)["deviation"] == "bigint" and dict(found.dtypes)["n"] == "bigint"
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    n, deviation, values, white = plain_whitening([(r["vec_id"], r["embedding"]) for r in rows[:]])
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    assert found.count() == 32 * n
    for r in found.collect():
        assert r["deviation"] == deviation[at[r["vec_id"]]]
        assert abs(abs(r["whitened"]) - abs(white[at[r["vec_id"]], r["component"] - 1])) < 1e-7
        assert r["identity_error"] < 1e-9


# ---- clustering


def plain_clusters(rows, count, rounds):
    kept = [(i, whole(v)) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [x for _, x in order[:count]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        middle = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c
                  for j, c in enumerate(middle)]
    return sorted(((i, nearest(x)[1], nearest(x)[0]) for i, x in kept), key=str), middle


@pytest.mark.parametrize("count", [1, 5, 60])
def test_clusters_equal_the_plain_ones(spark, count):
    rows = odd_vectors(8, 2)
    state, middle = centroids.clustered(vectors(spark, rows), clusters=count, size=8)
    want, plain_middle = plain_clusters(usable(rows, 8), count, 3)
    found = state.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=str) == want
    assert middle.tolist() == plain_middle
    for r in found:
        assert list(r["dots"]) == [sum(a * b for a, b in zip(r["x"], c)) for c in plain_middle]


def test_clusters_without_vectors_and_with_huge_numbers(spark):
    assert centroids.cluster_report(vectors(spark, [])).count() == 0
    assert centroids.cluster_report(vectors(spark, [(1, [1.0]), (2, None)])).count() == 0
    edge = [(1, [2.0 ** 21 - 1] + [0.0] * 63), (2, [1.0 - 2.0 ** 21] * 64)]
    assert {r["distance"] for r in centroids.cluster_report(vectors(spark, edge)).collect()} == {0}
    with pytest.raises(Exception, match="do not fit a long"):
        centroids.cluster_report(vectors(spark, [(1, [2.0 ** 22] * 64)])).count()


# ---- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    def holds(kind, match):
        number = [int(c) for c in match if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            checked = sum(number[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in number[-2::-2])
            return 13 <= len(number) <= 19 and checked % 10 == 0
        return kind == "email" or 9 <= len(number) <= 15
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, form in PLAIN.items()
                    for m in form.finditer(text) if holds(kind, m.group()))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.12+- ()0%é3\n", max_size=60))
def test_seeds_are_the_leftmost_matches(text):
    assert pii.listing(pii.seeds(text)) == plain_base(text)


def test_very_long_texts_are_read_once():
    for piece in ("1", "a", "a@", "+1(", "1.", "a.b@", "1 ", "(at)", "f:", "%"):
        text = piece * (200_000 // len(piece))
        found = pii.seeds(text)
        assert len(pii.occurrences(text, found)) <= len(text)


def test_contexts_and_candidates():
    text = "Write to jo (at) firm (dot) org, or ring 555 123 4567 now; host fe80::1:2:3 is up."
    found = pii.occurrences(text, pii.seeds(text))
    assert [(text[o["start"]:o["end"]], o["value"], o["kinds"]) for o in found] == [
        ("jo (at) firm (dot) org", "jo@firm.org", 1), ("555 123 4567", "5551234567", 12),
        ("fe80::1:2:3", "fe80::1:2:3", 2)]
    assert found[1]["patterns"] == ["or ring _", ", or ring _", "ring _ now", "or ring _ now",
                                    "_ now ;", "ring _"]
    assert pii.patterns("7", 0, 1) == ["^ ^ _", "^ ^ ^ _", "^ _ $", "^ ^ _ $", "_ $ $"]
    word = "w" * 500
    assert pii.patterns(f"{word} 7", 501, 502)[0].startswith("^ #")


def luhn_number(start, valid=True):
    for last in range(10):
        number = f"{start:015d}{last}"
        if pii.luhn(number) is valid:
            return number


def planted(hidden=20):
    """Cards in one context; numbers without a right check digit there and, partly, in a second
    context, which points to further ones; other numbers in prose."""
    rows, fails = [], [luhn_number(4000 + k, False) for k in range(hidden)]
    for k in range(99):
        rows.append((k, f"The card number is {luhn_number(100 + k)} until May {k}."))
    for k, number in enumerate(fails):
        rows.append((100 + k, f"The card number is {number} until June."))
        rows.append((200 + k, f"Booked under account {number} by us."))
    rows += [(300 + k, f"Booked under account {luhn_number(9000 + k, False)} by us.") for k in range(2)]
    rows += [(400 + k, f"In all {123456 + k} people came in {2000 + k}.") for k in range(20)]
    rows += [(None, rows[0][1]), (1, rows[1][1]), (500, None), (501, "")]
    return rows


def plain_bootstrap(rows, rounds):
    """Known strings after some rounds, over dictionaries of all pairs of pattern and string."""
    edges, seeds_of, kinds_of = defaultdict(set), defaultdict(set), defaultdict(int)
    for _, text in rows:
        text = text or ""
        for o in pii.occurrences(text, pii.seeds(text)):
            kinds_of[o["value"]] |= o["kinds"]
            if o["kind"] is not None:
                seeds_of[o["value"]].add(o["kind"])
            for p in o["patterns"]:
                edges[p].add(o["value"])
    known = {(v, k): 1.0 for v, ks in seeds_of.items() for k in ks}
    for _ in range(rounds):
        sure = {}
        for p, values in edges.items():
            for k in range(4):
                support = sum(known.get((v, k), 0.0) for v in values)
                if support >= pii.SUPPORT and support / (len(values) + pii.DOUBT) >= pii.CONFIDENCE:
                    sure[p, k] = support / (len(values) + pii.DOUBT)
        best = {}
        for v in set(kinds_of) - set(seeds_of):
            for k in range(4):
                if kinds_of[v] >> k & 1:
                    sides = [[c for (p, q), c in sure.items() if q == k and v in edges[p]
                              and p.startswith("_") is behind] for behind in (True, False)]
                    score = 1 - math.prod(1 - max(s, default=0.0) for s in sides)
                    best[v] = max(best.get(v, (0.0, 0)), (score, -k))
        known = {(v, k): 1.0 for v, ks in seeds_of.items() for k in ks} | {
            (v, -k): s for v, (s, k) in best.items() if s >= pii.ACCEPTED}
    return known


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_bootstrapping_equals_the_plain_one(spark, rounds):
    rows = planted()
    found = pii.read(spark.createDataFrame([(i, t, "r", "v", "n") for i, t in rows], TEXTS))
    known, _ = pii.bootstrapped(found, rounds)
    have = {(r["value"], r["kind"]): round(r["score"], 9) for r in known.collect()}
    assert have == {k: round(v, 9) for k, v in plain_bootstrap(rows, rounds).items()}


def test_patterns_discover_identifiers_in_rounds(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t, "r", "v", "n") for i, t in rows], TEXTS)
    once = {r["doc_id"]: r for r in pii.personal_data(docs, rounds=1).collect()}
    found = pii.personal_data(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    # The first round finds what stands in the cards' context, wherever it stands again.
    assert all(once[k + j]["n_added"] == 1 for k in range(20) for j in (100, 200))
    assert all(once[300 + k]["n_added"] == 0 and by_id[300 + k]["n_added"] == 1 for k in range(2))
    assert all(by_id[400 + k]["n_added"] == 0 for k in range(20))
    text = dict(rows)[300]
    at = text.index("0")
    assert by_id[300]["spans"] == f"card:{at}:{at + 16}" and by_id[300]["n_card"] == 0
    assert by_id[500]["spans"] == by_id[501]["spans"] == ""
    for r in found:
        base = plain_base(dict(rows).get(r["doc_id"]) or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["n_added"] or r["spans"] == base
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_personal_data_query_keeps_the_base_spans(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(
        f"{FOLDER}/documents.parquet").collect()}
    for r in QUERIES["op11_bootstrapped_pii"](spark, FOLDER).collect():
        base = plain_base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [
            base.count(kind + ":") for kind in pii.KINDS]
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))
