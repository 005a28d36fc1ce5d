"""Toxicity: a weighted finite-state grammar over clauses.

A chain of composed transducers reads each clause that holds the start of an insult or a threat verb.
The first turns words into classes (insult, threat verb, speaker, addressee, negation, speech verb,
preposition, quotation mark), the next mark what is denied, find a speaker's threat whose object is the
addressee, mark what is reported or quoted, and what is aimed at an addressee; one that reads from right
to left marks what a later speech verb reports.  What comes out are insults and threats with marks, each
with the weight of its stem.  A mark multiplies that weight by a factor, and a document's evidence is the
sum over its clauses.  Stems, factors and the curve from evidence to score are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage
from tallyloom.llm.batches import free_name, small_batches
from tallyloom.llm.samples import labelled_sample

#: The model is fitted on at most so many labelled documents of each class, first by a hash of doc_id.
PER_CLASS = 6000
#: Stems have so many letters at least and at most; a whole word ends with WORD_END.
STEM_LETTERS = (3, 12)
WORD_END = "$"
#: What a stem must bring: contexts in toxic documents, log-odds, and log-likelihood over the base.
LEAST_CONTEXTS = 8
LEAST_WEIGHT = 2.5
LEAST_EVIDENCE = 12.0
#: A longer stem stands for a shorter one if it covers so much of its toxic contexts.
SAME = 0.8
#: Weight of listed insults that the sample does not have.
LISTED = 4.0
#: Factors of the marks before anything is learned; a threat has no stem, its factor is its weight.
DENIED = 0.4
REPORTED = 0.6
TARGETED = 2.5
THREAT = 5.0
#: Learned logarithms of the factors stay about so near to those of the factors above unless the
#: labelled rows say otherwise (standard deviation of a normal prior).
SPREAD = 0.5
#: Words over which negation, an addressee, a speaker and an object before its verb reach.
REACH = 4
PREDICTED_FROM = 0.7

# Small word lists in English, German, French and Spanish.
INSULTS = """idiot moron loser scum trash worthless pathetic disgusting stupid clown imbecile
 dumbass asshole bastard bitch scumbag vermin
 dummkopf trottel vollidiot arschloch abschaum hurensohn wichser
 connard salaud abruti crétin ordure enculé salope
 idiota imbécil estúpido estúpida gilipollas basura cabrón pendejo""".split()
THREAT_VERBS = """kill hurt destroy beat stab shoot strangle murder töten umbringen schlagen tuer
 frapper détruire matar golpear destruir""".split()
SPEAKERS = "i we i'll we'll i'm ich wir je j nous yo nosotros voy vamos".split()
ADDRESSEES = """you your you're yourself u ya dich dir du ihr euch dein deine te toi tu vous ton ta
 tí usted ustedes vosotros""".split()
NEGATIONS = """not never no neither nor don't doesn't didn't isn't aren't wasn't won't nicht kein keine
 nie ne pas jamais aucun nunca jamás ni""".split()
SPEECH = """said says say called calls wrote writes claimed reported quoted alleged sagte nannte schrieb
 dit disait appelé écrit dijo llamó escribió""".split()
PREPOSITIONS = """for to with from at by about für mit von zu an bei pour avec de à chez para con
 por a sin""".split()
# Objects that stand before their verb.
OBJECTS = "dich euch te vous".split()
QUOTES = '"“”„«»'

CLAUSE_END = re.compile(r"[.!?;\n]+")
TOKEN = re.compile(rf"[^\W_]+(?:['’][^\W_]+)?|[{QUOTES}]")
ELISION = re.compile("['’]")


#: Marks of an insult or threat, as bits; a document's sums are kept by their combination.
IS_DENIED, IS_REPORTED, IS_AIMED, IS_THREAT = 1, 2, 4, 8
COMBINATIONS = 16
BITS = np.array([[m >> k & 1 for k in range(4)] for m in range(COMBINATIONS)], dtype=float)


class Transducer:
    """A deterministic weighted transducer: ``step`` gives the next state, the symbol that it writes
    and a weight.  A symbol is a class and its marks.  Composition feeds what the first writes to the
    second and multiplies the weights; arcs over the few classes are remembered, those over words not."""

    start: object = 0
    reads_words = False

    def step(self, state, symbol):
        raise NotImplementedError

    def __matmul__(self, second: Transducer) -> Transducer:
        return Composed(self, second)


class Composed(Transducer):
    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.arcs = first, second, {}
        self.start = first.start, second.start
        self.reads_words = first.reads_words

    def step(self, state, symbol):
        arc = self.arcs.get((state, symbol))
        if arc is None:
            one, middle, before = self.first.step(state[0], symbol)
            two, written, after = self.second.step(state[1], middle)
            arc = (one, two), written, before * after
            if not self.reads_words:
                self.arcs[state, symbol] = arc
        return arc


class Recognition(Transducer):
    """Words in, classes out; an insult carries the weight of its longest stem.

    An elided word (d'abruti) whose whole form says nothing is read by what follows the apostrophe.
    """

    reads_words = True

    def __init__(self, stems: dict[str, float]):
        self.stems, self.lengths = stems, sorted({len(s) for s in stems}, reverse=True)

    def insult(self, word: str) -> float:
        marked = word + WORD_END
        for n in self.lengths:
            if n <= len(marked) and marked[:n] in self.stems:
                return self.stems[marked[:n]]
        return 0.0

    def step(self, state, symbol):
        weight = self.insult(symbol)
        if not weight and symbol not in CLASSES:
            symbol = ELISION.split(symbol)[-1]
            weight = self.insult(symbol)
        if weight:
            return state, ("insult", 0), weight
        return state, (CLASSES.get(symbol, "word"), 0), 1.0


class Negation(Transducer):
    """State: words that the last negation still reaches.  A denied threat verb is a plain word."""

    def step(self, state, symbol):
        kind, marks = symbol
        if kind == "not":
            return REACH, symbol, 1.0
        rest = max(state - 1, 0)
        if state and kind == "insult":
            return rest, (kind, marks | IS_DENIED), 1.0
        if state and kind == "verb":
            return rest, ("word", marks), 1.0
        return rest, symbol, 1.0


class Threats(Transducer):
    """State: words that a speaker and an object still reach, and whether the word before was a
    speaker's threat verb.  The addressee right after such a verb is its object and is written as a
    threat, also one that owns it (your); so is a verb whose object stands before it."""

    start = (0, 0, "")

    def step(self, state, symbol):
        speaker, before, last = state
        kind, marks = symbol
        rest = max(speaker - 1, 0), max(before - 1, 0)
        threat = ("threat", marks | IS_THREAT), 1.0
        if kind == "speaker":
            return (REACH, rest[1], ""), symbol, 1.0
        if kind == "verb" and speaker:
            return ((0, 0, ""), *threat) if before else ((*rest, "verb"), symbol, 1.0)
        if kind in ("addressee", "object") and last == "verb":
            return (0, 0, ""), *threat
        if kind == "object" and last != "preposition":
            return (rest[0], REACH, ""), symbol, 1.0
        return (*rest, "preposition" if kind == "preposition" else ""), symbol, 1.0


class Report(Transducer):
    """State: whether a speech verb came before in the clause, and whether a quotation is open."""

    start = (False, False)

    def step(self, state, symbol):
        told, quoted = state
        kind, marks = symbol
        if kind == "speech":
            return (True, quoted), symbol, 1.0
        if kind == "quote":
            return (told, not quoted), symbol, 1.0
        heavy = kind in ("insult", "threat") and (told or quoted)
        return state, (kind, marks | IS_REPORTED) if heavy else symbol, 1.0


class Target(Transducer):
    """State: words that the last addressee still reaches."""

    def step(self, state, symbol):
        kind, marks = symbol
        if kind in ("addressee", "object"):
            return REACH, symbol, 1.0
        rest = max(state - 1, 0)
        return rest, (kind, marks | IS_AIMED) if state and kind == "insult" else symbol, 1.0


class LaterReport(Transducer):
    """Reads from right to left.  State: whether a speech verb follows, and whether the word read last
    was one, whose subject decides: what the addressee says does not report an insult to it."""

    start = (False, False)

    def step(self, state, symbol):
        told, open_verb = state
        kind, marks = symbol
        if open_verb:
            told = told or kind not in ("addressee", "object")
        if kind in ("insult", "threat") and told:
            symbol = kind, marks | IS_REPORTED
        return (told, kind == "speech"), symbol, 1.0


CLASSES = ({w: "preposition" for w in PREPOSITIONS} | {w: "verb" for w in THREAT_VERBS}
           | {w: "speaker" for w in SPEAKERS} | {w: "addressee" for w in ADDRESSEES}
           | {w: "object" for w in OBJECTS} | {w: "not" for w in NEGATIONS}
           | {w: "speech" for w in SPEECH} | {q: "quote" for q in QUOTES})


@dataclass(frozen=True)
class Model:
    """Stems with their weights, the factors of the marks (denied, reported, aimed, threat), and the
    two numbers that turn evidence into a score."""

    stems: tuple[tuple[str, float], ...]
    slope: float = 2.0
    offset: float = -4.0
    factors: tuple[float, float, float, float] = (DENIED, REPORTED, TARGETED, THREAT)

    def weights(self) -> np.ndarray:
        """What a combination of marks multiplies a stem's weight by."""
        return np.where(BITS > 0, self.factors, 1.0).prod(axis=1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.offset + self.slope * np.log1p(evidence))))


class Grammar:
    def __init__(self, model: Model):
        self.weights = model.weights()
        self.left = (Recognition(dict(model.stems))
                     @ (Negation() @ (Threats() @ (Report() @ Target()))))
        self.right = LaterReport()
        self.found = ahocorasick.Automaton()
        for stem in [*dict(model.stems), *(v + WORD_END for v in THREAT_VERBS)]:
            self.found.add_word(stem.removesuffix(WORD_END), len(stem.removesuffix(WORD_END)))
        self.found.make_automaton()

    def clause(self, text: str, quoted: bool, sums: np.ndarray) -> None:
        """Add what a clause says; ``quoted``: a quotation is open where it begins."""
        recognised, (denied, (threats, (_, aimed))) = self.left.start
        state, written = (recognised, (denied, (threats, ((False, quoted), aimed)))), []
        for token in TOKEN.findall(text):
            state, symbol, weight = self.left.step(state, token)
            written.append((symbol, weight))
        state = self.right.start
        for symbol, weight in reversed(written):
            state, (kind, marks), _ = self.right.step(state, symbol)
            if kind in ("insult", "threat"):
                sums[marks] += weight

    def sums(self, text: str | None) -> np.ndarray:
        """Stem weights of a whole text by combination of marks, over the clauses that hold the start
        of a stem or threat verb.  Quotations go on over ends of sentences, to the end of the line."""
        text = (text or "").lower()
        sums = np.zeros(COMBINATIONS)
        upto, counted, quoted = 0, 0, False
        for end, length in self.found.iter(text):
            at = end + 1 - length
            if at < upto or at and text[at - 1].isalnum():
                continue
            start = upto
            for mark in ".!?;\n":
                start = max(start, text.rfind(mark, upto, at) + 1)
            stop = CLAUSE_END.search(text, end + 1)
            upto = stop.start() if stop else len(text)
            line = text.rfind("\n", counted, start) + 1
            if line:
                counted, quoted = line, False
            quoted ^= sum(text.count(q, counted, start) for q in QUOTES) % 2 == 1
            counted = start
            self.clause(text[start:upto], quoted, sums)
        return sums

    def evidence(self, text: str | None) -> float:
        return float(self.sums(text) @ self.weights)


@lru_cache(maxsize=4)
def grammar(model: Model) -> Grammar:
    return Grammar(model)


def _evidence(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        rules = grammar(model)
        return pd.Series([rules.evidence(t) for t in texts], dtype=float)

    # Marked so that a filter on the result does not compute it a second time.
    return evidence.asNondeterministic()(text)


def _sums(text: Column, model: Model) -> Column:
    @F.pandas_udf("array<double>")
    def sums(texts: pd.Series) -> pd.Series:
        rules = grammar(model)
        return pd.Series([rules.sums(t) for t in texts], dtype=object)

    return sums(text)


def _stem_counts(sample: DataFrame) -> DataFrame:
    """Contexts of each word start in toxic and in other sample documents, a row a start.

    A context is a word with the word before it, and counts once a class however many documents
    have it: else the words of one document with many near copies would look like signs.
    """
    least, most = STEM_LETTERS
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    pairs = F.zip_with(F.concat(F.array(F.lit("")), words), words,
                       lambda before, word: F.struct(before.alias("before"), word.alias("word")))
    contexts = (sample.select("label", F.explode(pairs).alias("c"))
                .select("label", "c.before", "c.word").where(F.length("word") >= least).distinct()
                .groupBy("word").agg(F.sum("label").alias("toxic"),
                                     F.sum(1 - F.col("label")).alias("other")))
    marked = F.concat("word", F.lit(WORD_END))
    starts = F.transform(
        F.sequence(F.lit(least), F.least(F.length("word") + 1, F.lit(most + 1))),
        lambda n: F.substring(marked, F.lit(1), n))
    return (contexts.select("toxic", "other", F.explode(starts).alias("stem"))
            .groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


def choose_stems(counts: pd.DataFrame, toxic: int, other: int) -> dict[str, float]:
    """Stems with their log-odds.  ``counts``: stem, toxic, other (contexts in the sample), all
    that pass the thresholds.  A stem that a longer one stands for is left out, then every stem
    that extends a chosen one."""
    rows = {r.stem: (r.toxic, r.other) for r in counts.itertuples()}
    same = {s[:-1] for s, (t, _) in rows.items()
            if s[:-1] in rows and t >= SAME * rows[s[:-1]][0]}
    chosen: dict[str, float] = {}
    for stem in sorted(set(rows) - same, key=lambda s: (len(s), s)):
        if not any(stem[:n] in chosen for n in range(STEM_LETTERS[0], len(stem))):
            t, o = rows[stem]
            chosen[stem] = math.log((t + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (other + 1))
    return chosen


def fit_factors(sums: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Factors of the marks, slope and offset (a model without stems) of a logistic curve over
    log(1 + evidence), by damped Newton steps.

    ``sums``: stem weights of each labelled document by combination of marks.  The logarithm of each
    factor has a normal prior around that of the constants above, so a mark that the labelled rows
    do not have keeps its constant.
    """
    prior = np.log([DENIED, REPORTED, TARGETED, THREAT])
    tight = np.array([1 / SPREAD ** 2] * 4 + [1e-2] * 2)
    centre = np.array([*prior, 0.0, 0.0])

    def state(b):
        parts = sums * np.exp(BITS @ b[:4])
        evidence = parts.sum(axis=1)
        z = b[4] * np.log1p(evidence) + b[5]
        loss = weight @ (np.logaddexp(0, z) - label * z) + tight @ (b - centre) ** 2 / 2
        return parts, evidence, z, loss

    b, damping = np.array([*prior, 1.0, -2.0]), 1e-3
    parts, evidence, z, loss = state(b)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z))
        x = np.column_stack([b[4] * (parts @ BITS) / (1 + evidence)[:, None], np.log1p(evidence),
                             np.ones(len(z))])
        slope = x.T @ (weight * (label - p)) - tight * (b - centre)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(tight)
        step = np.linalg.solve(bend + damping * np.diag(np.diag(bend)), slope)
        new = b + np.clip(step, -1, 1)
        new[4] = max(new[4], 0.0)
        tried = state(new)
        if tried[3] <= loss:
            moved, b, (parts, evidence, z, loss) = np.abs(new - b).max(), new, tried
            damping = max(damping / 4, 1e-9)
            if moved < 1e-9:
                break
        elif damping > 1e9:
            break
        else:
            damping *= 8
    return Model((), float(b[4]), float(b[5]), tuple(map(float, np.exp(b[:4]))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model from labelled documents (``labels``: doc_id, toxic) that are not held out.

    Without labels of both classes: the listed insults and a fixed curve.
    """
    listed = {s + WORD_END: LISTED for s in INSULTS}
    sample, counts = labelled_sample(docs, labels, "toxic", held_out(F.col("doc_id")), per_class)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not (toxic and other):
        return Model(tuple(sorted(listed.items())))
    counted = stage(_stem_counts(sample), "stems")
    # Every word's whole form is a stem, so these sums are the contexts of the sample.
    whole = counted.where(F.col("stem").endswith(WORD_END)).agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    toxic, other = whole["toxic"] or 0, whole["other"] or 0
    base = (toxic + 1) / (toxic + other + 2)
    rate = F.col("toxic") / (F.col("toxic") + F.col("other"))
    gain = F.col("toxic") * F.log(rate / base) + F.when(F.col("other") > 0, F.col("other") * F.log(
        (1 - rate) / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    strong = counted.where((F.col("toxic") >= LEAST_CONTEXTS) & (odds >= LEAST_WEIGHT)
                           & (gain >= LEAST_EVIDENCE)).toPandas()
    stems = listed | choose_stems(strong, toxic, other)
    model = Model(tuple(sorted(stems.items())))
    seen = sample.select("label", _sums(F.col("text"), model).alias("x")).toPandas()
    share = {c: counts[c] / sizes[c] for c in (0, 1)}
    fitted = fit_factors(np.array(seen["x"].tolist()), seen["label"].to_numpy(float),
                         seen["label"].map(share).to_numpy(float))
    return replace(fitted, stems=model.stems)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from PREDICTED_FROM) and evidence of every
    row of ``docs`` (doc_id, text); whole texts.

    Null and empty texts have no evidence and get the curve's lowest score; repeated rows and rows
    without doc_id are returned as they come (the latter not held out); an empty table gives an
    empty result; other columns are not looked at.
    """
    seen = small_batches(docs).select(F.col("doc_id").cast("long"),
                                      _evidence(F.col("text"), model).alias("evidence"))
    score = 1 / (1 + F.exp(-(F.lit(model.offset) + F.lit(model.slope) * F.log1p("evidence"))))
    return (seen.withColumn("score", score)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"), "evidence"))


def accepted_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted toxic.

    Null and empty texts are kept, unless the model predicts texts without evidence toxic; repeated
    rows are judged alike; an empty table gives an empty result.
    """
    found = free_name(docs, "_evidence")
    score = 1 / (1 + F.exp(-(F.lit(model.offset) + F.lit(model.slope) * F.log1p(F.col(found)))))
    return (small_batches(docs).withColumn(found, _evidence(F.col("text"), model))
            .where(score < PREDICTED_FROM).drop(found))
