"""Personal data: seeds found by form, then bootstrapped contextual extraction.

Entities that their form gives away (the seeds) induce lexical patterns: the words around them.
Patterns and the identifier-like strings that they surround make a bipartite graph.  Scores pass over
it in rounds, as Spark joins: a pattern is worth the share of its strings that are known to be of a
kind, a string what its best patterns are worth; strings with a high score become known and induce
patterns of their own.  In the end the strings that confident patterns point to are added to the
seeds: identifiers whose form alone says nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage
from tallyloom.llm.batches import small_batches

#: Kinds in the order in which spans are listed; a string's ``kinds`` has bit k for KINDS[k].
KINDS = ("email", "ip", "card", "phone")
#: Different strings of its kind that a pattern must have, and the share that they must be.
SUPPORT = 5
CONFIDENCE = 0.7
#: Added to a pattern's strings before the share is taken: few strings are weak evidence.
DOUBT = 1.0
#: Score from which a string is known.
ACCEPTED = 0.8
ROUNDS = 3
#: Hot patterns and strings are dealt to so many parts in joins.
SALTS = 32
#: Longer words and strings are known by a digest.
_LONG = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits take no part in what follows them, so possessive runs match the same and never go back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Strings that may be identifiers: addresses with a spelled-out sign, groups of hexadecimals or
# masked numbers, runs of digits.
_AT = re.compile(r"(?:@|[(\[{] ?at ?[)\]}])", re.IGNORECASE)
_AT_RIGHT = re.compile(r" ?[\w-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[\w-]+)*", re.IGNORECASE)
_GROUPS = re.compile(r"(?<![\w.:])[0-9A-Fa-f]{1,4}(?:[.:]{1,2}[0-9A-Fa-fxX*]{1,4}){3,}+(?![\w:])")
_DIGITS = re.compile(r"(?<![\w.])[+(]?[0-9](?:[ ()./-]{0,2}[0-9])++(?!\w)")
_WORD = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]")
_HAS_SIGN = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]", re.IGNORECASE)

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from their @ signs: a run of local characters is read once."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and (text[start - 1].isascii()
                                 and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            after = domain.end()
        else:
            # What stands before this sign belongs to no later match.
            after = at + 1
        at = text.find("@", after)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def seeds(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by form; a match that fails its test is dropped and not tried again."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (
                part.lstrip("0") or "0" for part in m.group().split("."))):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        number = _digits(m.group())
        if 13 <= len(number) <= 19 and luhn(number):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def _kinds_of(text: str) -> int:
    """Bits of the kinds that a run of digits may be."""
    n = len(_digits(text))
    return (4 if 8 <= n <= 24 else 0) | (8 if 6 <= n <= 17 else 0)


def _spelled(text: str) -> Iterator[tuple[int, int, int]]:
    """Addresses around each @ or (at); the word before the sign is read from its end."""
    after = 0
    for sign in _AT.finditer(text):
        right = _AT_RIGHT.match(text, sign.end())
        stop = sign.start() - (sign.start() > after and text[sign.start() - 1] == " ")
        start = stop
        while start > after and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        if right and start < stop:
            yield start, right.end(), 1
        after = sign.end()


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, kinds) of strings that may be identifiers, apart from ``taken`` and each other."""
    found = list(_spelled(text))
    for m in _GROUPS.finditer(text):
        if _digits(m.group()):
            found.append((*m.span(), 2))
    for m in _DIGITS.finditer(text):
        if kinds := _kinds_of(m.group()):
            found.append((*m.span(), kinds))
    found.sort(key=lambda c: (c[0], -c[1]))
    busy, kept, at, upto = sorted(taken), [], 0, 0
    for start, end, kinds in found:
        while at < len(busy) and busy[at][1] <= start:
            at += 1
        if start >= upto and (at == len(busy) or end <= busy[at][0]):
            kept.append((start, end, kinds))
            upto = end
    return kept


def _known_as(text: str) -> str:
    return text if len(text) <= _LONG else "#" + xxhash.xxh3_128_hexdigest(text)


def value_of(text: str, kinds: int) -> str:
    """What two spellings of one identifier share: its digits, or its text in lower case."""
    if kinds & 12:
        return _known_as(_digits(text))
    text = re.sub(r" ?[(\[{] ?at ?[)\]}] ?", "@", text.lower())
    return _known_as(re.sub(r" ?[(\[{] ?dot ?[)\]}] ?", ".", text))


def _word(text: str) -> str:
    return "0" if text[0].isdigit() else _known_as(text.lower())


def _before(text: str, start: int) -> list[str]:
    """The three words and signs before a place; the window grows until the third is whole."""
    width = 64
    while True:
        words = _WORD.findall(text[max(start - width, 0):start])
        if len(words) > 3 or width >= start:
            return (["^"] * 3 + [_word(w) for w in words])[-3:]
        width *= 2


def _after(text: str, end: int) -> list[str]:
    words = []
    for m in _WORD.finditer(text, end):
        words.append(_word(m.group()))
        if len(words) == 2:
            break
    return (words + ["$"] * 2)[:2]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span, ``_`` in its place."""
    third, second, first = _before(text, start)
    next_, last = _after(text, end)
    found = [f"{second} {first} _", f"{third} {second} {first} _", f"{first} _ {next_}",
             f"{second} {first} _ {next_}", f"_ {next_} {last}"]
    return found + [f"{first} _"] if first[0].isalpha() else found


def listing(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def occurrences(text: str, found: dict[str, list[Span]]) -> list[dict]:
    """Seeds and candidates of a text with their values and patterns."""
    taken = [span for kind in KINDS for span in found[kind]]
    spans = [(a, b, 1 << k, k) for k, kind in enumerate(KINDS) for a, b in found[kind]]
    spans += [(a, b, kinds, None) for a, b, kinds in candidates(text, taken)]
    return [{"kind": kind, "start": a, "end": b, "kinds": kinds, "value": value_of(text[a:b], kinds),
             "patterns": patterns(text, a, b)} for a, b, kinds, kind in spans]


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_OCCURRENCES = ("array<struct<kind:int,start:int,end:int,kinds:int,value:string,"
                "patterns:array<string>>>")
_FOUND = ("doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string,"
          f" base string, seen {_OCCURRENCES}")


def read(docs: DataFrame) -> DataFrame:
    """One pass over whole texts: base spans and all occurrences, a row a document, numbered."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = {kind: [] for kind in KINDS}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                able = text and _HAS_SIGN.search(text)
                found = seeds(text) if able else nothing
                base = listing(found)
                rows.append((doc_id, *(len(found[kind]) for kind in KINDS), _sha256(base), base,
                             occurrences(text, found) if able else []))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone",
                                              "base_sha256", "base", "seen"])

    found = small_batches(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    # Numbered as written: the numbers stay when rows are read again.
    return stage(found.mapInPandas(scan, _FOUND)
                 .withColumn("doc_id", F.col("doc_id").cast("long"))
                 .withColumn("row", F.monotonically_increasing_id()), "personal")


def _bit(kind: Column) -> Column:
    return F.pow(F.lit(2), kind).cast("int")


def salted_join(rows: DataFrame, table: DataFrame, key: str, salt: str) -> DataFrame:
    """Inner join on ``key``; a hot key's ``rows`` are dealt out by the hash of ``salt``, and
    ``table`` (few rows a key) is repeated for every part."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return (rows.withColumn("_part", F.pmod(F.hash(salt), F.lit(SALTS)))
            .join(table.withColumn("_part", parts), [key, "_part"]).drop("_part"))


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, known): edges (pattern, value, kinds, seeds, total) between patterns and strings, and
    the strings that are seeds, (value, kind, score).

    Patterns with fewer than SUPPORT different strings cannot become confident and are left out.
    ``seeds`` has a bit for each kind of which the string is a seed; ``total`` counts the pattern's
    strings.
    """
    seen = found.select(F.explode("seen").alias("s")).select(
        "s.value", "s.kinds", "s.patterns",
        F.when(F.col("s.kind").isNull(), 0).otherwise(F.col("s.kinds")).alias("seeds"))
    pairs = stage(seen.select("value", "kinds", "seeds", F.explode("patterns").alias("pattern"))
                  .groupBy("pattern", "value")
                  .agg(F.bit_or("kinds").alias("kinds"), F.bit_or("seeds").alias("seeds")), "pairs")
    totals = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).where(
        F.col("total") >= SUPPORT)
    edges = stage(salted_join(pairs, totals, "pattern", "value"), "edges")
    of_kind = [F.when(F.col("seeds").bitwiseAND(1 << k) > 0, F.lit(k)) for k in range(len(KINDS))]
    known = (seen.where("seeds > 0").groupBy("value").agg(F.bit_or("seeds").alias("seeds"))
             .select("value", F.explode(F.array_compact(F.array(*of_kind))).alias("kind"),
                     F.lit(1.0).alias("score")))
    return edges, stage(known, "seeds")


def confident_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, support, confidence): what the known strings of each pattern say of it."""
    support = F.sum("score")
    return (salted_join(edges.select("pattern", "value", "total"), known, "value", "pattern")
            .groupBy("pattern", "kind").agg(support.alias("support"), F.max("total").alias("total"))
            .withColumn("confidence", F.col("support") / (F.col("total") + DOUBT))
            .where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
            .select("pattern", "kind", "support", "confidence"))


def accepted_strings(edges: DataFrame, confident: DataFrame) -> DataFrame:
    """(value, kind, score) of strings that are no seeds and whose best patterns lift them to ACCEPTED.

    What stands before a string and what stands behind it are taken as two witnesses; of several
    kinds the one with the higher score holds.
    """
    fits = F.col("kinds").bitwiseAND(_bit(F.col("kind"))) > 0
    side = F.col("pattern").startswith("_")
    witnesses = (salted_join(edges.where("seeds = 0").select("pattern", "value", "kinds"),
                             confident.select("pattern", "kind", "confidence"), "pattern", "value")
                 .where(fits).groupBy("value", "kind")
                 .agg(F.coalesce(F.max(F.when(side, F.col("confidence"))), F.lit(0.0)).alias("behind"),
                      F.coalesce(F.max(F.when(~side, F.col("confidence"))), F.lit(0.0)).alias("before")))
    scored = witnesses.withColumn("score", 1 - (1 - F.col("before")) * (1 - F.col("behind")))
    return (scored.groupBy("value")
            .agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
            .select("value", (-F.col("best.kind")).alias("kind"), F.col("best.score").alias("score"))
            .where(F.col("score") >= ACCEPTED))


def bootstrapped(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(known strings, confident patterns) after ``rounds`` passes over the graph; each pass is
    written to the shared folder."""
    edges, seeded = graph(found)
    known, confident = seeded, None
    for _ in range(rounds):
        confident = stage(confident_patterns(edges, known), "patterns")
        known = stage(seeded.unionByName(accepted_strings(edges, confident)), "known")
    return known, confident


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Spans of personal data in every row of ``docs`` (doc_id, text), by bootstrapping.

    Returns doc_id, n_email, n_ip, n_card and n_phone (base spans), base_sha256 (of their listing),
    spans (all spans: kind:start:end, by kind, then start) and n_added.  Places count code points.
    Known strings are tagged wherever they stand and their form allows their kind.  Null and empty
    texts have no spans; rows without doc_id, repeated rows and repeated ids are returned as they
    come, and repeated texts count once in the graph; an empty table gives an empty result; other
    columns are not looked at.
    """
    found = read(docs)
    known, _ = bootstrapped(found, rounds)
    is_open = F.exists("seen", lambda s: s["kind"].isNull())
    shown = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    strings = (found.where(is_open).select("row", F.explode("seen").alias("s"))
               .where("s.kind IS NULL").select("row", "s.value", "s.start", "s.end", "s.kinds"))
    best = known.groupBy("value").agg(
        F.collect_set("kind").alias("of_kinds"))
    may = F.filter("of_kinds", lambda k: F.col("kinds").bitwiseAND(_bit(k)) > 0)
    added = (salted_join(strings, best, "value", "row").withColumn("kind", F.array_min(may))
             .where("kind IS NOT NULL").groupBy("row")
             .agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    base = F.transform(F.filter("seen", lambda s: s["kind"].isNotNull()),
                       lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                          s["end"].alias("end")))
    more = (found.where(is_open).join(added, "row", "left")
            .select(*shown, F.when(F.col("added").isNull(), F.col("base"))
                    .otherwise(_listed(F.concat(base, "added"))).alias("spans"),
                    F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added")))
    rest = found.where(~is_open).select(*shown, F.col("base").alias("spans"),
                                        F.lit(0).cast("long").alias("n_added"))
    return more.unionAll(rest)
