"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage
from tallyloom.llm.batches import free_name, small_batches
from tallyloom.llm.components import connected

BITS = 64
SEED = 42
#: Words a shingle, and the largest number of differing bits of a link.
SHINGLE_WORDS = 4
MAX_BITS = 4
#: Blocks that a fingerprint is cut into.  Two of six must agree when four bits differ, which
#: leaves 15 keys of about 21 bits; take eight (70 keys of 32 bits) beyond some 10^9 fingerprints.
BLOCKS = 6
#: Blocks shared by more fingerprints than this are compared in tiles of at most TILE by TILE.
CROWD = 48
TILE = 512
_ROWS = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text.

    A-Z are lower-cased, words are runs of other bytes than space and 09-0D, shingles are joined
    by single spaces.  Fewer words than a shingle needs: all of them; none, or null: 0.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = zip(*(tokens[k:] for k in range(min(words, len(tokens)))))
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(b" ".join(s), SEED) for s in shingles], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(values), _ROWS):
        part = values[k:k + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * ones > len(values), bitorder="little")
    return int(chosen.view("<u8")[0])


def _row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes of all columns of a row, the second of where its nulls are too: hashes skip nulls,
    and one of 64 bits is the same for a few of 10^10 rows."""
    nulls = [F.col(f"`{c}`").isNull() for c in docs.columns]
    values = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*values), F.xxhash64(*nulls, *values)]


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, row and check (hashes of all columns) and fingerprint (long, the 64 bits) of every
    row of ``docs``; whole texts."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = np.array([fingerprint(t, words) for t in batch.pop("text")], np.uint64)
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"),
                               fingerprint=marks.view(np.int64))

    row, check = _row_hashes(docs)
    return small_batches(docs).select(
        F.col("doc_id").cast("long"), row.alias("row"), check.alias("check"), "text").mapInPandas(
        marked, "doc_id long, row long, check long, fingerprint long")


def _masks(blocks: int, max_bits: int) -> list[int]:
    """One mask for each choice of blocks that a close pair may agree in, as signed longs."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in whole]


def _close(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what all close pairs among ``values`` (unsigned) would join.

    Each value is compared with those not reached yet, so a dense group is done in a few passes,
    and at most one link a value comes out.
    """
    left, links = values, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                links += [(x, y) for y in found]
                queue += list(found)
                left = left[~near]
    return links


def close_links(marks: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS,
                crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join exactly what the pairs with at most
    ``max_bits`` differing bits join; not every such pair is listed.

    ``marks``: one row a distinct ``fingerprint``.  Close pairs agree in ``blocks - max_bits``
    blocks, so rows are keyed by each choice of that many blocks.  Keys with up to ``crowd`` rows
    are joined with themselves; larger ones are cut into chunks, each pair of chunks being one
    small group of rows that yields a spanning forest.  No key reaches one task as a whole.
    """
    keys = F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m).cast("long"))
                                  for m in _masks(blocks, max_bits)])).alias("choice", "part")
    keyed = marks.select("fingerprint", keys)
    sizes = keyed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(keyed.join(sizes, ["choice", "part"]), "blocks")

    few = shared.where(F.col("n") <= crowd).drop("n")
    other = few.withColumnRenamed("fingerprint", "other")
    plain = (few.join(other, ["choice", "part"])
             .where((F.col("fingerprint") < F.col("other"))
                    & _close(F.col("fingerprint"), F.col("other"), max_bits))
             .select(F.col("fingerprint").alias("a"), F.col("other").alias("b")))

    chunks = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    many = (shared.where(F.col("n") > crowd)
            .withColumn("chunks", chunks)
            .withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("choice", "part", "fingerprint", F.least("own", "with").alias("i"),
                    F.greatest("own", "with").alias("j")))

    def joined(tile_rows: pd.DataFrame) -> pd.DataFrame:
        links = _forest(tile_rows["fingerprint"].to_numpy().view(np.uint64), max_bits)
        found = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    tiled = (many.groupBy("choice", "part", "i", "j")
             .applyInPandas(joined, "a long, b long"))
    return plain.unionAll(tiled).distinct()


def _members(docs: DataFrame, words: int, max_bits: int, blocks: int) -> DataFrame:
    """``fingerprints`` with root (a fingerprint) and component_id."""
    marked = stage(fingerprints(docs, words), "fingerprints")
    nodes = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(close_links(nodes.select("fingerprint"), max_bits, blocks))
    rooted = stage(nodes.join(roots, F.col("fingerprint") == F.col("node"), "left")
                   .select("fingerprint", "first",
                           F.coalesce("root", "fingerprint").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(smallest, "root").select("fingerprint", "root", "component_id")
    return marked.join(known, "fingerprint")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over
    links of at most ``max_bits`` bits) for every row of ``docs`` (doc_id, text).

    Equal fingerprints are one node, so copies are never paired.  Null and empty texts have
    fingerprint zero and link like any other; repeated rows are all returned; rows without doc_id
    take part, and a component of only such rows has a null component_id.  An empty table gives an
    empty result; other columns are not looked at.
    """
    return _members(docs, words, max_bits, blocks).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id")


def kept_documents(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                   blocks: int = BLOCKS) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``, with all its columns: that
    with the smallest doc_id (rows without one last).  Among rows with that doc_id hashes of all
    columns decide, so rows repeated in full are kept once and reruns agree.  Null and empty texts are
    one group; an empty table gives an empty result."""
    members = _members(docs, words, max_bits, blocks)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.struct("row", "check").alias("row"))
    mine = free_name(docs, "_row")
    chosen = (members.groupBy("root").agg(F.min(order).alias("least"))
              .select(F.col("least.row").alias(mine)).distinct())
    return (docs.withColumn(mine, F.struct(*[h.alias(n) for h, n in zip(_row_hashes(docs), ("row", "check"))]))
            .join(chosen, mine, "left_semi").dropDuplicates([mine]).drop(mine))
