"""Quality rules, line first: bad lines go, then documents that lose too much of their text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.batches import free_name, small_batches

#: Rules on whole documents: the fewest words, and the most words in repeated windows, per cent.
LEAST_WORDS = 20
WINDOW = 8
REPEATED_PERCENT = 30
#: A document is rejected if its lines lose more than this part of its words, per cent.
LOST_PERCENT = 50
#: A line shorter than this many words must end with a closing mark.
SHORT_LINE = 10
#: A line is navigation if so many of its words, and a third of them, are separators of links.
LINKS = 3
#: Symbols, or exclamation and question marks (beyond three), that a line may have for 100 words.
SYMBOL_PERCENT = 30
SHOUT_PERCENT = 50

# Symbols that count, marks that close a line, separators of navigation, and phrases
# of page furniture (whole lines of few words that hold one of them).
SYMBOLS = "[#*$%&|<>]"
CLOSING = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
SEPARATORS = ("|", "»", "›", "·", "•", ">", "/", "::")
FURNITURE = (
    "(?i)cookies?|javascript|terms of (?:use|service)|privacy policy|all rights reserved"
    "|sign (?:in|up)|log ?in|subscribe|newsletter|read more|click here|share (?:this|on)"
    "|skip to content|powered by|lorem ipsum"
    "|mentions légales|tous droits réservés|lire la suite|s'abonner"
    "|impressum|datenschutz|alle rechte vorbehalten|weiterlesen"
    "|aviso legal|todos los derechos reservados|leer más|suscríbete")

_SYMBOLS, _CLOSING, _FURNITURE = (re.compile(p) for p in (SYMBOLS, CLOSING, FURNITURE))
_SEPARATORS = {s.encode() for s in SEPARATORS}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words which the text has twice or more.

    Runs get exact numbers by joining shorter runs pairwise, so no two different runs share one.
    """
    count = len(words) - window + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    runs = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == len(words):
        return 0
    length = 1
    while length < window:
        step = min(length, window - length)
        pairs = runs[:len(runs) - step] * (int(runs.max()) + 1) + runs[step:]
        distinct, runs = np.unique(pairs, return_inverse=True)
        length += step
        if len(distinct) == len(pairs):
            return 0
    twice = np.bincount(runs) > 1
    marks = np.zeros(len(words) + 1, np.int64)
    found = np.flatnonzero(twice[runs])
    marks[found] += 1
    marks[found + window] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line that is not blank breaks a rule: few words without a closing mark, too many
    symbols, shouting, navigation, or page furniture."""
    n = len(words)
    if n < SHORT_LINE and not _CLOSING.search(line):
        return True
    if 100 * len(_SYMBOLS.findall(line)) > SYMBOL_PERCENT * n:
        return True
    if 100 * (line.count("!") + line.count("?")) > max(300, SHOUT_PERCENT * n):
        return True
    links = sum(w in _SEPARATORS for w in words)
    if links >= LINKS and 3 * links >= n:
        return True
    return n <= 2 * SHORT_LINE and _FURNITURE.search(line) is not None


def measured(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned).

    Words are runs of other characters than space and 09-0D.  ``cleaned`` is the text without the
    lines that fail and those repeating an earlier line; kept documents lose no more than
    LOST_PERCENT of their words to it.
    """
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines, seen, kept_lines, duplicates, left = text.split("\n"), set(), [], 0, 0
    for line in lines:
        own = line.encode().split()
        if not own:
            kept_lines.append(line)
        elif line in seen:
            duplicates += 1
        elif not line_fails(line, own):
            kept_lines.append(line)
            left += len(own)
        seen.add(line)
    repeats = repeated_words(words)
    base_failed = len(words) < LEAST_WORDS or 100 * repeats > REPEATED_PERCENT * len(words)
    kept = not base_failed and 100 * (len(words) - left) <= LOST_PERCENT * len(words)
    return (len(words), chars, len(_SYMBOLS.findall(text)), duplicates, repeats, base_failed, kept,
            "\n".join(kept_lines))


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, cleaned string")


def _measures(text: Column) -> Column:
    @F.pandas_udf(FIELDS)
    def all_measures(texts: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pd.DataFrame([measured(t) for t in texts], columns=names)

    # Marked so that a filter on the result does not compute it a second time.
    return all_measures.asNondeterministic()(text)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of ``measured``, base_failed, kept and the cleaned text of every row of
    ``docs`` (doc_id, text).

    Null texts count as empty and fail; repeated rows and rows without doc_id are returned as they
    come; an empty table gives an empty result; other columns are not looked at.
    """
    return (small_batches(docs)
            .select(F.col("doc_id").cast("long"), _measures(F.col("text")).alias("m"))
            .select("doc_id", "m.*"))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; ``text`` is the cleaned text and
    ``n_chars``, if there is such a column, its length.

    Null and empty texts fail the rules and go; repeated rows are judged one by one and stay as often
    as they come; an empty table gives an empty result; other columns are carried along.
    """
    found = free_name(docs, "_measures")
    kept = (small_batches(docs).withColumn(found, _measures(F.col("text"))).where(F.col(found)["kept"])
            .withColumn("text", F.col(found)["cleaned"]))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.drop(found)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The verdicts in SQL.
VERDICTS_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
placed AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS pos
           FROM worded WHERE len(words) >= {WINDOW}),
twice AS (SELECT rid, pos FROM placed
          QUALIFY count(*) OVER (PARTITION BY rid, array_to_string(words[pos:pos + {WINDOW - 1}], ' ')) > 1),
repeated AS (SELECT rid, count(DISTINCT pos + k) AS n FROM twice, range({WINDOW}) t(k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM texts),
counted AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own,
                   row_number() OVER (PARTITION BY rid, line ORDER BY nr) > 1 AS again FROM lines),
sized AS (SELECT *, len(own) AS n, len(regexp_extract_all(line, '{SYMBOLS}')) AS symbols,
                 length(line) - length(translate(line, '!?', '')) AS shouts,
                 len(list_filter(own, lambda w: w IN ({", ".join(map(_quoted, SEPARATORS))}))) AS links
          FROM counted WHERE len(own) > 0),
judged AS (SELECT *,
    (n < {SHORT_LINE} AND NOT regexp_matches(line, {_quoted(CLOSING)}))
    OR 100 * symbols > {SYMBOL_PERCENT} * n OR 100 * shouts > greatest(300, {SHOUT_PERCENT} * n)
    OR (links >= {LINKS} AND 3 * links >= n)
    OR (n <= {2 * SHORT_LINE} AND regexp_matches(line, {_quoted(FURNITURE)})) AS fails FROM sized),
summed AS (SELECT rid, count(*) FILTER (again) AS doubles,
                  coalesce(sum(n) FILTER (NOT again AND NOT fails), 0) AS remaining FROM judged GROUP BY rid),
base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
         coalesce(doubles, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(words) < {LEAST_WORDS} OR 100 * coalesce(r.n, 0) > {REPEATED_PERCENT} * len(words) AS base_failed,
         coalesce(remaining, 0) AS remaining
  FROM worded LEFT JOIN summed USING (rid) LEFT JOIN repeated r USING (rid))
SELECT * EXCLUDE (remaining),
       NOT base_failed AND 100 * (n_words - remaining) <= {LOST_PERCENT} * n_words AS kept
FROM base
"""
