"""Corpus operators against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tallyloom.functions.staging import new_path
from tallyloom.llm import chat, components, licenses, linerules, mixing, pieces, quality, simhash
from tallyloom.llm import toxicity, vectors, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, " \
         "size long, key string, root string, label int, fingerprint string, component_id long"


def documents(spark, rows):
    """Documents (doc_id, text, source) with further columns named like those that operators make."""
    return spark.createDataFrame(
        [(i, t, None, s, None, None, None, None, None, None, None, None) for i, t, s in rows], SCHEMA)


def sentence(rng, words):
    return " ".join(rng.choice(["the", "river", "stone", "walked", "over", "green", "hills", "slowly",
                                "while", "birds", "sang", "near", "old", "houses"]) for _ in range(words))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    long_text = "\n".join(sentence(rng, 12) + "." for _ in range(4000))
    return [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (None, "No id here at all.", "b"),
            (None, None, None), (4, "Same row.", "c"), (4, "Same row.", "c"), (4, "Other text.", "c"),
            (5, long_text, "a"), (6, "é" * 5000, "ü"), (7, "x " * 3000, "b"),
            (8, "Ein kurzer Satz mit 😀 darin.", None)]


DOCUMENT_OPERATORS = {
    "quality": lambda d, labels: quality.scores(d, quality.fit(d, labels)),
    "mixing": lambda d, labels: mixing.mixture(d),
    "simhash": lambda d, labels: simhash.near_duplicates(d),
    "toxicity": lambda d, labels: toxicity.scores(d, toxicity.fit(d, labels)),
    "rules": lambda d, labels: linerules.verdicts(d),
    "pieces": lambda d, labels: pieces.token_digests(d, pieces.read_model(MODEL)),
}


@pytest.mark.parametrize("name", sorted(DOCUMENT_OPERATORS))
def test_odd_rows_and_an_empty_table(spark, odd_rows, name):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (4, 0, 1), (5, 1, 0), (None, 1, 1),
                                    (7, 0, 1), (6, 7, 9)], "doc_id long, quality int, toxic int")
    docs = documents(spark, odd_rows)
    apply = DOCUMENT_OPERATORS[name]
    found = apply(docs, labels).toPandas()
    assert sorted(map(str, found["doc_id"].astype("Int64"))) == sorted(
        str(pd.NA if i is None else i) for i, _, _ in odd_rows)
    for flag in ("held_out", "predicted", "kept", "target", "fingerprint", "n_tokens"):
        assert flag not in found or found[flag].notna().all()
    assert apply(docs.limit(0), labels.limit(0)).count() == 0
    assert apply(docs, labels.limit(0)).count() == len(odd_rows)


# Quality and toxicity

def labelled(spark, folder="/root/testdata/sf0.01"):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return read("documents"), read("labels")


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels.select("doc_id", label), "doc_id").toPandas()
    assert len(rows) > 50 and rows["score"].between(0, 1).all()
    return (rows["predicted"] == rows[label]).mean()


def test_quality_on_held_out_rows_and_labels_out_of_reach(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    assert accuracy(quality.scores(docs, model), labels, "quality") > 0.93
    turned = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, turned)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))
    held = quality.scores(docs, model).where("held_out").select("doc_id").collect()
    assert {r[0] for r in held} == {r[0] for r in docs.select("doc_id").collect()
                                    if zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_additive_score_is_the_sum_of_its_tables():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    label = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.boost(x, label, np.ones(600))
    assert ((model.score(x) > 0.5) == label).mean() > 0.9
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    bins = model.bins(x[:1])[0]
    total = model.base + sum(t[b] for t, b in zip(model.tables, bins)) + sum(
        t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]]
        for (i, j), t in zip(model.pairs, model.pair_tables))
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    scored = toxicity.scores(docs, model)
    assert accuracy(scored, labels, "toxic") > 0.93
    clean = scored.join(labels.where("toxic = 0"), "doc_id")
    assert clean.where("predicted = 1").count() <= 0.01 * clean.count()
    turned = labels.withColumn("toxic", F.when(
        F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == model


def test_clauses_are_scored_not_words():
    rules = toxicity.Grammar(toxicity.Model((("idiot$", 4.0), ("fool", 3.0))))
    plain = rules.evidence("Well, idiot and so on.")
    assert plain == 4.0 and rules.evidence("They sell idiotic things.") == 0.0
    assert rules.evidence("What foolish talk.") == 3.0
    assert rules.evidence("This one is not an idiot.") == pytest.approx(4 * toxicity.DENIED)
    assert rules.evidence("You are an idiot.") == pytest.approx(4 * toxicity.TARGETED)
    assert rules.evidence("They said the man was an idiot.") == pytest.approx(4 * toxicity.REPORTED)
    assert rules.evidence('The word "idiot" is old.') == pytest.approx(4 * toxicity.REPORTED)
    assert rules.evidence("I will kill you.") == toxicity.THREAT
    assert rules.evidence("I will not kill you. Killers kill.") == 0.0
    assert rules.evidence("Not now. Idiot!") == 4.0
    assert rules.evidence("IDIOT!! Idiot") == 8.0 and rules.evidence(None) == 0.0


@pytest.mark.parametrize("text, factor", [
    ("I will kill the process for you.", 0), ("For you I kill the process.", 0),
    ("Ich werde dich töten.", toxicity.THREAT / 4), ("Te voy a matar.", toxicity.THREAT / 4),
    ("He said I will kill your dog.", toxicity.THREAT * toxicity.REPORTED / 4),
    ("You are an idiot, he said.", toxicity.TARGETED * toxicity.REPORTED),
    ("You idiot, you said that.", toxicity.TARGETED),
    ('"You idiot. You idiot." he said.', 2 * toxicity.TARGETED * toxicity.REPORTED),
    ('A "quote opens.\nYou idiot.', toxicity.TARGETED),
])
def test_objects_later_reports_and_quotations(text, factor):
    rules = toxicity.Grammar(toxicity.Model((("idiot$", 4.0),)))
    assert rules.evidence(text) == pytest.approx(4 * factor)


def plain_reading(model, text):
    """The grammar's sums by looking at every pair of words of every clause, without states."""
    stems, reach, sums = dict(model.stems), toxicity.REACH, [0.0] * 16

    def longest(word):
        known = [s for s in stems if (word + "$").startswith(s)]
        return stems[max(known, key=len)] if known else 0.0

    for line in (text or "").lower().split("\n"):
        quotes = 0
        for clause in re.split("[.!?;]", line):
            words = re.findall(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”„«»]", clause)
            kinds, weights = [], []
            for w in words:
                if not longest(w) and w not in toxicity.CLASSES:
                    w = re.split("['’]", w)[-1]
                weights.append(longest(w))
                kinds.append("insult" if weights[-1] else toxicity.CLASSES.get(w, "word"))
            near = lambda i, *names: any(k in names for k in kinds[max(i - reach, 0):i])
            kinds = ["word" if k == "verb" and near(i, "not") else k for i, k in enumerate(kinds)]
            said = [i for i, k in enumerate(kinds) if k == "speech"]
            threats, since = [], 0  # A threat begins anew after the one before it.
            for i, k in enumerate(kinds):
                lately = range(max(i - reach, since), i)
                spoken = any(kinds[j] == "speaker" for j in lately)
                faced = any(kinds[j] == "object" and (j == since or kinds[j - 1] != "preposition") for j in lately)
                before = i - 1 >= since and kinds[i - 1] == "verb" and any(
                    kinds[j] == "speaker" for j in range(max(i - 1 - reach, since), i - 1))
                if k == "verb" and spoken and faced or k in ("addressee", "object") and before:
                    threats.append(i)
                    since = i + 1
            for i, k in enumerate(kinds):
                if k != "insult" and i not in threats:
                    continue
                inside = (quotes + sum(x == "quote" for x in kinds[:i])) % 2
                told = any(j < i for j in said) or any(
                    j > i + 1 and kinds[j - 1] not in ("addressee", "object") or j == i + 1 and i not in threats
                    for j in said)
                marks = 2 * bool(inside or told)
                if i in threats:
                    sums[marks + 8] += 1
                else:
                    aimed = any(q in ("addressee", "object") and j not in threats
                                for j, q in enumerate(kinds[:i]) if j >= i - reach)
                    sums[marks + near(i, "not") + 4 * aimed] += weights[i]
            quotes += sum(k == "quote" for k in kinds)
    return sums


def test_grammar_against_a_plain_reading():
    rng = random.Random(11)
    model = toxicity.Model((("idiot$", 4.0), ("foo", 3.0), ("fools$", 2.0)))
    words = ["idiot", "fool", "fools", "kill", "töten", "i", "ich", "you", "your", "dich", "te", "not", "said",
             "for", "d'idiot", "the", "stone", "river", '"', "„", "hill", "skill"]
    rules = toxicity.Grammar(model)
    for _ in range(4000):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", "", ".", "!", ";", "\n"])
                        for _ in range(rng.randrange(30)))
        if rng.random() < 0.2:
            text = text.upper()
        assert rules.sums(text) == pytest.approx(plain_reading(model, text)), text


def test_query_rows_against_a_plain_reading(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.001")
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = toxicity.scores(docs, model).collect()
    assert len(found) == len(texts) and any(r["evidence"] for r in found)
    for r in found:
        evidence = float(np.dot(plain_reading(model, texts[r["doc_id"]]), model.weights()))
        score = 1 / (1 + np.exp(-(model.offset + model.slope * np.log1p(evidence))))
        assert r["evidence"] == pytest.approx(evidence) and r["score"] == pytest.approx(score)
        assert r["predicted"] == (r["score"] >= 0.7)


def test_factors_are_learned_from_labelled_clauses():
    rng = np.random.default_rng(5)
    sums = np.zeros((4000, 16))
    kind = rng.choice([0, 1, 2, 4, 8], 4000)
    sums[np.arange(4000), kind] = np.where(kind == 8, 1.0, 4.0)
    # Labels as the constants have it, then against them: denied insults toxic, aimed ones not.
    for odds in ({0: 0.1, 1: 0.02, 2: 0.02, 4: 0.98, 8: 0.98}, {0: 0.1, 1: 0.98, 2: 0.02, 4: 0.02, 8: 0.98}):
        label = (rng.random(4000) < [odds[k] for k in kind]).astype(float)
        model = toxicity.fit_factors(sums, label, np.ones(4000))
        denied, reported, aimed, threat = model.factors
        assert (denied > 1 > aimed) == (odds[1] > odds[4]) and reported < 1 < threat
        assert np.mean((model.score(sums @ model.weights()) > 0.5) == label) > 0.9
    kept = toxicity.fit_factors(sums[kind == 0], label[kind == 0], np.ones((kind == 0).sum()))
    assert kept.factors == pytest.approx((toxicity.DENIED, toxicity.REPORTED, toxicity.TARGETED, toxicity.THREAT))


def test_elided_words_are_looked_up_without_their_article():
    rules = toxicity.Grammar(toxicity.Model((("abruti$", 4.0), ("ordure$", 3.0), ("encul", 5.0))))
    assert rules.evidence("Espèce d'abruti !") == 4.0 == rules.evidence("Espèce d’abruti !")
    assert rules.evidence("L'ordure et fils d'enculé.") == 8.0
    assert rules.evidence("Ce n'est pas d'abruti.") == pytest.approx(4 * toxicity.DENIED)
    assert rules.evidence("They don't sell abruti.") == pytest.approx(4 * toxicity.DENIED)
    assert rules.evidence("D'abrutis, l'ordureux.") == 0.0


def test_accepted_documents_keep_their_columns(spark):
    docs = documents(spark, [(1, "You idiot, you moron, you scum.", "a"), (2, "A quiet day.", "a"),
                             (3, None, "b")])
    kept = toxicity.accepted_documents(docs, toxicity.Model((("idiot$", 5.0), ("moron$", 5.0))))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}


# Mixing

def test_targets_stop_at_twice_the_source_and_are_nearly_met(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(1, 80)), rng.choice(["big"] * 40 + ["mid"] * 8 + ["tiny", None]))
            for i in range(3000)]
    found = mixing.mixture(documents(spark, rows)).toPandas()
    sizes = {i: len(t.split()) for i, t, _ in rows}
    assert (found["size"] == found["doc_id"].map(sizes)).all()
    assert (found["taken"] <= 2 * found["size"]).all()
    per = found.groupby("source", dropna=False).agg(size=("size", "sum"), told=("source_size", "first"),
                                                    target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["told"]).all()
    weight = {"big": 5, "mid": 2, "tiny": 1}
    level, open_sources = 1.5 * per["size"].sum(), {s: weight.get(s, 5) for s in per.index}
    want = {}
    while open_sources:
        share = level / sum(open_sources.values())
        full = {s: 2.0 * per.loc[s, "size"] for s, w in open_sources.items()
                if share * w > 2.0 * per.loc[s, "size"]}
        if not full:
            want |= {s: share * w for s, w in open_sources.items()}
            break
        want |= full
        level -= sum(full.values())
        open_sources = {s: w for s, w in open_sources.items() if s not in full}
    assert all(per.loc[s, "target"] == pytest.approx(t) for s, t in want.items())
    assert ((per["taken"] - per["target"]).abs() <= 40).all()
    again = mixing.mixture(documents(spark, rows[::-1]).repartition(7)).toPandas()
    order = ["doc_id", "taken"]
    assert found[order].sort_values(order).values.tolist() == again[order].sort_values(order).values.tolist()


def test_mixed_documents_are_repeated_as_told(spark):
    rng = random.Random(6)
    docs = documents(spark, [(i, sentence(rng, 10), "ab"[i % 2]) for i in range(200)])
    told = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs).collect()}
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in told.items() if n}


# SimHash

def brute_fingerprint(text):
    words = [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ")
             .replace("\f", " ").split(" ") if w]
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, close):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components(spark):
    rng = random.Random(9)
    base = [sentence(rng, 60) for _ in range(12)]
    texts = base + [t.replace("stone", "stones", 1) for t in base] + base[:3] + [None, "", "One two"]
    found = simhash.near_duplicates(documents(spark, [(100 - i, t, "a") for i, t in enumerate(texts)]))
    got = {r["doc_id"]: r for r in found.collect()}
    marks = [brute_fingerprint(t) for t in texts]
    assert [got[100 - i]["fingerprint"] for i in range(len(texts))] == [f"{m:016x}" for m in marks]
    roots = reachable(marks, lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for i, r in enumerate(roots):
        smallest[r] = min(smallest.get(r, 999), 100 - i)
    assert [got[100 - i]["component_id"] for i in range(len(texts))] == [smallest[r] for r in roots]


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    marks = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for _ in range(400)}
    marks |= {rng.getrandbits(64) for _ in range(100)}
    ordered = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in ordered]
    frame = spark.createDataFrame([(m,) for m in signed], "fingerprint long")
    links = simhash.close_links(frame, crowd=5, tile=16)
    found = {r["node"]: r["root"] for r in components.connected(links).collect()}
    roots = reachable(ordered, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = {}
    for m, r in zip(signed, roots):
        groups.setdefault(r, []).append(m)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_one_document_of_a_group_stays(spark):
    same = "a b c d e f g h i j"
    docs = documents(spark, [(5, same, "x"), (3, same, "x"), (3, same, "x"), (9, "quite another text here", "y"),
                             (None, "only row without id in its group", "z"), (None, same, "x")])
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["source"]) for r in kept.collect()) == [
        ("3", "x"), ("9", "y"), ("None", "z")]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(50)]
    star = [(200, k) for k in range(201, 400)]
    frame = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected(frame).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 200 for i in range(200, 400)}
    assert components.connected(frame.limit(0)).count() == 0


# Embeddings

def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    near = [centre + rng.normal(scale=0.12, size=24) for _ in range(60)]
    rows = [(int(i), [float(x) for x in v], int(k)) for i, (v, k) in enumerate(
        zip([*near, *rng.normal(size=(120, 24))], [0] * 60 + [0, 1] * 60))]
    rows += [(500, rows[3][1], 0), (501, [2 * x for x in rows[4][1]], 0), (502, rows[5][1], 1),
             (503, None, 0), (504, [], 0), (505, [0.0] * 24, 0), (506, [float("nan")] * 24, 0),
             (507, [None] + [1.0] * 23, 0), (508, rows[3][1], None), (509, rows[3][1][:5], 0),
             (510, [float("inf")] + [1.0] * 23, 0), (None, rows[3][1], 0), (3, rows[3][1], 0)]
    frame = spark.createDataFrame([(i, v, k, 1, "x") for i, v, k in rows],
                                  "vec_id long, embedding array<double>, label int, n_links int, node string")
    found = vectors.near_duplicates(frame, tile=16).collect()

    def able(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def close(a, b):
        if not (able(a) and able(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

    roots = reachable(rows, close)
    want = []
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None]
        least = min(ids, default=None)
        want.append((r[0], sum(close(r, o) for j, o in enumerate(rows) if j != k), least, r[0] == least))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=key) == sorted(
        want, key=key)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


# WARC

def test_archives_round_trip_with_odd_pages(spark):
    long_page = "<p>ü" + "text \r\n\r\n0\r\n\r\n " * 4000
    quoted = "see WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 300
    pages = [(1, "http://a/", long_page), (2, "http://a/\r\nX: y", long_page), (3, None, None), (4, "u", ""),
             (5, "u", quoted), (6, "u", "short"), (7, "u", "short"), (None, "u", "no id" * 300),
             (8, "u", "twice" * 300), (8, "u", "twice" * 300), (9, "u", "é" * 499 + "ab"), (10, "u", "é" * 499 + "ab")]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages],
                                  "page_id long, url string, html string, type string, payload_bytes int")
    path = new_path(spark, "archives")
    warc.write_archives(frame, path, chunk_bytes=1000, segment_bytes=4000)
    found = warc.read_archives(spark, path).collect()
    assert all(r["verified"] for r in found) and len(found) == len(pages)
    text = {i: t or "" for i, _, t in pages}
    for r in found:
        whole = text[r["page_id"]].encode()
        assert r["payload_bytes"] == len(whole) and r["payload_digest"] == hashlib.sha1(whole).hexdigest()
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == whole
    assert {(r["page_id"], r["refers_to"]) for r in found if r["record_type"] == "revisit"} == {(1, 2), (9, 10)}
    empty = new_path(spark, "archives")
    warc.write_archives(frame.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_damaged_segments_are_told(spark):
    frame = spark.createDataFrame([(1, "u", "y" * 9000), (2, "u", "z" * 9000)],
                                  "page_id long, url string, html string")
    path = new_path(spark, "archives")
    warc.write_archives(frame, path, chunk_bytes=700, segment_bytes=2000)
    read = warc.read_records(spark, path)
    assert read.count() == 10 and not read.where("cut").count()
    whole = warc.reassembled(read)
    assert [r["whole"] for r in whole.collect()] == [True, True]
    less = warc.reassembled(read.where("coalesce(segment, 0) <> 3 OR body NOT LIKE '%y%'"))
    assert {r["page_id"]: r["whole"] for r in less.collect()} == {1: False, 2: True}
    assert warc.decode_chunks(b"3\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.decode_chunks(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    for damaged in (b"", b"3\r\nab", b"zz\r\nabc\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        assert warc.decode_chunks(damaged) is None


# Chat

def test_every_assistant_turn_is_an_example(spark):
    hard = "a\\b </s> [INST] \\</s> <\\/s> [/ROLE] x"
    turns = [(1, 0, "system", "s"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None),
             (1, 4, "assistant", ""), (1, 5, "user", "left over"), (2, 0, "user", "only"),
             (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (None, None, None, None)]
    frame = spark.createDataFrame([(*t, "x") for t in turns],
                                  "conv_id long, turn long, role string, text string, loss string")
    made = chat.examples(frame).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"], r["final"]) for r in made] == [
        (None, 1, True), (1, 1, False), (1, 2, False), (1, 3, True), (2, 1, True), (3, 1, False), (3, 2, True)]
    second = made[2]["text"]
    assert second.startswith(made[1]["text"]) and second.count(chat.END) == 5
    spans = [r["text"][r["loss_start"]:r["loss_start"] + r["loss_length"]] for r in made]
    assert [s.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for s in spans] == [
        "", hard, "", "", "", "a", "b"]
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(frame)).collect()}
    assert got[1]["n_turns"] == 6 and got[1]["loss_sha256"] == hashlib.sha256(hard.encode()).hexdigest()
    lines = "".join(f"{r or ''}\n{t or ''}\n" for c, _, r, t in turns if c == 1)
    assert got[1]["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert got[3]["loss_chars"] == 2 and got[2]["loss_chars"] == 0
    assert chat.digests(chat.examples(frame.limit(0))).count() == 0


# Licences

def test_licenses_in_long_texts_and_near_misses(spark):
    rng = random.Random(8)
    filler = [sentence(rng, 400) for _ in range(3)]
    mit = licenses.TEMPLATES[2][1]
    changed = mit.replace("without restriction", "with restriction").replace("sublicense", "lend")
    half = " ".join(mit.split()[:30])
    rows = [(1, f"{filler[0]} {mit.upper()} {filler[1]}", "a"), (2, f"{filler[2]}\n{changed}", "a"),
            (3, f"{half} {filler[0]}", "a"), (4, "Released under the MIT License.", "a"),
            (5, "Released under the", "a"), (6, None, "a"), (7, "", "a"), (None, f"x y {mit}", "a"),
            (1, "Licensed under CC BY-NC 4.0.", "b")]
    found = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(documents(spark, rows)).collect()}
    assert set(found) == {(1, "MIT"), (2, "MIT"), (4, "MIT"), (None, "MIT"), (1, "CC-BY-NC-4.0")}
    assert found[1, "MIT"] == 1.0 and 0.8 <= found[2, "MIT"] < 1.0
    assert licenses.scan(documents(spark, rows).limit(0)).count() == 0


def test_edited_licenses_at_every_offset_against_all_stretches(spark):
    rng = random.Random(21)

    def edited(text, inserted):
        words = text.split()
        return " ".join([*words[:len(words) // 2], *sentence(rng, inserted).split(), *words[len(words) // 2:]])
    kinds = [(licenses.TEMPLATES[k], extra) for k, extra in ((5, 7), (11, 8), (2, 19))]
    rows = [(1000 * n + offset, f"{sentence(rng, offset)} {edited(text, extra)} {sentence(rng, 90)}", "a")
            for n, ((_, text), extra) in enumerate(kinds) for offset in range(70)]

    def shingles(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]

    want = {}
    for doc_id, text, _ in rows:
        have = shingles(text)
        for license, template in licenses.TEMPLATES:
            signs = set(shingles(template))
            size = 1 << (len(signs) - 1).bit_length()
            length = size + max(size // 2, 1)
            part = max(len(signs & set(have[i:i + length])) / len(signs) for i in range(len(have)))
            if part >= 0.8:
                want[doc_id, license] = max(part, want.get((doc_id, license), 0))
    assert {(1000 * n + offset, license) for n, ((license, _), _) in enumerate(kinds)
            for offset in range(70)} <= set(want)
    found = licenses.scan(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["license"]): r["containment"] for r in found} == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    assert {(d, name): part for d, name, part in con.execute(licenses.SCAN_SQL).fetchall()} == want


def test_short_license_templates_are_whole_word_sequences(spark):
    rows = [(1, "© 2020 Nobody.\nALL  rights, reserved!", "a"), (2, "Overall rights reserved", "a"),
            (3, "all rights are reserved", "a"), (4, "// SPDX-License-Identifier: MIT\n", "a"),
            (5, "SPDX-License-Identifier: MITx", "a"), (6, "all rights reserved", "a"), (7, None, "a"),
            (8, "# SPDX-License-Identifier: Apache-2.0", "a"), (None, "All rights reserved", "b"),
            (9, "all_rights_reserved2 all rights", "a")]
    found = sorted(map(tuple, licenses.scan(documents(spark, rows)).collect()), key=str)
    assert found == sorted([
        (1, "All-rights-reserved", 1.0), (4, "MIT", 1.0), (6, "All-rights-reserved", 1.0),
        (8, "Apache-2.0", 1.0), (None, "All-rights-reserved", 1.0)], key=str)
    only = licenses.scan(documents(spark, rows), [("short", "rights reserved"), ("one", "nobody")])
    assert {(r["doc_id"], r["license"]) for r in only.collect()} == {
        (1, "short"), (1, "one"), (2, "short"), (6, "short"), (None, "short")}
    with pytest.raises(ValueError, match="without a word"):
        licenses.scan(documents(spark, rows), [("none", "---")])


# Quality rules

def test_repeated_words_against_all_windows():
    rng = random.Random(12)
    for n in [*range(0, 20), 60, 200, 400]:
        words = [rng.choice("ab" if n < 60 else "abcdefgh").encode() for _ in range(n)]
        seen, covered = {}, set()
        for i in range(n - 7):
            seen.setdefault(tuple(words[i:i + 8]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                covered |= {p + k for p in places for k in range(8)}
        assert linerules.repeated_words(words) == len(covered)


def test_lines_are_judged_before_the_document(spark):
    good = "This line is a plain sentence with more than ten words in it, so it stays."
    other = "Another plain sentence stands here, and nobody would want to take it away from us."
    nav = "Home | News | Sport | Weather | Contact"
    text = f"{nav}\n{good}\n{other}\n{good}\n\nShort title\nRead more about it here"
    n, chars, symbols, doubles, repeats, failed, kept, cleaned = linerules.measured(text)
    assert (symbols, doubles, repeats, failed, kept) == (4, 1, 32, True, False)
    assert cleaned == f"{good}\n{other}\n"
    assert n == len(text.split()) and chars == sum(map(len, text.split()))
    lost = linerules.measured("\n".join(f"w{k} x{k} y{k} z{k}" for k in range(20)))
    assert not lost[5] and not lost[6]
    docs = documents(spark, [(1, f"{nav}\n{good}\n{other}", "a"), (2, "too short", "a"), (3, None, "a")])
    kept = linerules.cleaned_documents(docs)
    assert kept.columns == docs.columns
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()] == [
        (1, f"{good}\n{other}", len(f"{good}\n{other}"))]


# Pieces

HARD = ["", " ", "  ", "▁", "a▁b", "\n", "\n\nabc\t x", "x" * 500, " " * 100, "a" + " " * 37 + "b\n" + " " * 17,
        "<s></s><unk><0x41>", "日本語テキスト😀é́", "ﷺ\u0000z", "\ufffd", "don't  stop   ...!!!!????--------====",
        "1234567890123", "\r\n \r\n", "éèçñßüö ÀÉ", "http://a.b/c?d=e&f=g", "\ufeffbom", "ab" * 3000]


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = pieces.piece_model(pieces.read_model(MODEL))
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab eéñ▁ \n\t.,!1thinger日😀") for _ in range(rng.randint(0, 60)))
                    for _ in range(800)]
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
        assert own.round_trip(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
    docs = documents(spark, [(k, t, "a") for k, t in enumerate(HARD)])
    for r in pieces.encode(docs, pieces.read_model(MODEL)).collect():
        assert r["ids"] == library.encode(HARD[r["doc_id"]]) and r["decoded"] == library.decode(r["ids"])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    own = pieces.PieceModel(pieces.read_model(MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in ["some words that come and go", "words that come again", "some more words"]:
        assert own.round_trip(text)[1] == ",".join(map(str, library.encode(text)))
