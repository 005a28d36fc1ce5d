"""Whitening of embeddings; the covariance comes from variances alone, by polarisation.

The variance of the sum of two dimensions is both variances and twice their covariance.  So squares
of centred values are added up, exactly, for every dimension and for the sum of every two, and all
covariances follow as differences.  Values are whole numbers (floor(64 * number) + 1000000); they are
centred on the whole number next to the mean before they are squared, and the rest of the mean, at
most one half, is taken out of the sums in whole numbers as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.staging import stage
from tallyloom.llm.centroids import is_finite

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Numbers up to this size: their whole forms fit a long.
LARGEST = 1 << 56
#: Squares of so large whole numbers can be added up in 64 bits over a batch.
_NARROW = 1 << 19
#: Rows that are squared together.
_ROWS = 4096
#: An eigenvalue below this share of the trace is rounding: the dimension does not vary.
FLAT = 1e-12


@dataclass(frozen=True)
class Fit:
    """What whitens the vectors of one length: their number, whole centres and what is left of the
    sums at these (S - n * centre), axes as columns, and their eigenvalues over the trace."""

    n: int
    centre: np.ndarray
    rest: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def flat(self) -> np.ndarray:
        return self.values <= FLAT * self.trace

    def whiten(self, z: np.ndarray) -> np.ndarray:
        """Whitened rows of ``z``, whole numbers less the centre; NaN where nothing varies."""
        left = np.array([r / self.n for r in self.rest])
        length = np.sqrt(np.where(self.flat, np.nan, self.values))
        return (z.astype(np.float64) - left) @ self.axes / length


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, x) of the vectors whose numbers are all there and finite."""
    def whole(v: Column) -> Column:
        number = v.cast("double")
        return F.when(F.abs(number) < LARGEST, F.floor(number * SCALE) + SHIFT).otherwise(
            F.raise_error(F.lit("a number of 2^56 or more has no whole form in a long")).cast("long"))

    return (vectors.where(is_finite(F.col("embedding")) & (F.size("embedding") > 0))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("size"),
                    F.transform("embedding", whole).alias("x")))


def _by_size(batch: pd.DataFrame) -> Iterator[tuple[int, pd.Index, np.ndarray]]:
    """The vectors of a batch as matrices of one length and at most _ROWS rows."""
    for size, part in batch.groupby("size"):
        for k in range(0, len(part), _ROWS):
            some = part.iloc[k:k + _ROWS]
            yield int(size), some.index, np.stack(some["x"].to_list()).astype(np.int64)


def _added(sums: dict[int, list[int]], size: int, values: list[int]) -> None:
    known = sums.get(size)
    sums[size] = values if known is None else [a + b for a, b in zip(known, values)]


def _entries(sums: dict[int, list[int]]) -> Iterator[pd.DataFrame]:
    for size, values in sums.items():
        yield pd.DataFrame({"size": size, "entry": np.arange(len(values)),
                            "value": [Decimal(v) for v in values]})


def _total(parts: DataFrame) -> dict[int, list[int]]:
    """Sums by length of vector and entry, over all tasks."""
    rows = parts.groupBy("size", "entry").agg(F.sum("value").alias("value")).collect()
    out: dict[int, list[int]] = {}
    for size in {r["size"] for r in rows}:
        found = sorted((r["entry"], int(r["value"])) for r in rows if r["size"] == size)
        out[size] = [v for _, v in found]
    return out


def totals(whole: DataFrame) -> dict[int, list[int]]:
    """For each length of vector the sum of every dimension, then the number of vectors."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for size, _, x in _by_size(batch):
                # Halves of 32 bits, so that a batch of any numbers is added up exactly.
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                _added(sums, size, [(int(h) << 32) + int(l) for h, l in zip(high, low)] + [len(x)])
        yield from _entries(sums)

    return _total(whole.select("size", "x").mapInPandas(
        add, "size int, entry long, value decimal(38,0)"))


def pair_squares(z: np.ndarray) -> list[int]:
    """Sums of z_a^2 for a = b and of (z_a + z_b)^2 for a < b, by a, then b."""
    if np.abs(z).max(initial=0) >= _NARROW:
        z = z.astype(object)
    out = []
    for a in range(z.shape[1]):
        pair = z[:, a:] + z[:, a:a + 1]
        pair[:, 0] = z[:, a]
        out.extend(int(v) for v in (pair * pair).sum(axis=0))
    return out


def squares(whole: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, list[int]]:
    """:func:`pair_squares` of all vectors less the centre of their length.

    A task adds up its rows, so the shuffle has one row a task, length and pair of dimensions.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for size, _, x in _by_size(batch):
                _added(sums, size, pair_squares(x - centres[size]))
        yield from _entries(sums)

    return _total(whole.select("size", "x").mapInPandas(
        add, "size int, entry long, value decimal(38,0)"))


def covariance(n: int, rest: list[int], sums: list[int]) -> np.ndarray:
    """Covariances, divisor n, from the sums of squares at the centres.

    With w = n * x - S the sum of (w_a + w_b)^2 is n^2 times that at the centres less
    n * (rest_a + rest_b)^2: whole numbers, rounded once at the end.
    """
    size = len(rest)
    at = iter(sums)
    found: dict[tuple[int, int], int] = {}
    for a in range(size):
        for b in range(a, size):
            left = rest[a] if a == b else rest[a] + rest[b]
            found[a, b] = n * n * next(at) - n * left * left
    out = np.empty((size, size))
    for (a, b), pair in found.items():
        both = pair if a == b else (pair - found[a, a] - found[b, b]) // 2
        out[a, b] = out[b, a] = both / n ** 3
    return out


def principal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(values))])
    return np.maximum(values, 0.0), axes * sign


def fit(whole: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vector over all rows of :func:`whole_vectors`.

    Sums and the squares of a vector's length in numbers come to the driver, nothing else.
    """
    sums = totals(whole)
    centres = {size: np.array([(2 * s + t[-1]) // (2 * t[-1]) for s in t[:-1]], np.int64)
               for size, t in sums.items()}
    squared = squares(whole, centres)
    fits = {}
    for size, t in sums.items():
        n = t[-1]
        rest = [s - n * int(c) for s, c in zip(t[:-1], centres[size])]
        matrix = covariance(n, rest, squared[size])
        values, axes = principal(matrix)
        fits[size] = Fit(n, centres[size], rest, axes[:, :components], values[:components],
                         float(np.trace(matrix)))
    return fits


def identity_errors(whole: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each length the largest entry of the whitened covariance less the identity.

    Dimensions that do not vary are left out; NaN if none does.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_size(batch):
                known = fits[size]
                # Whitened rows are centred; what rounding leaves of their mean is in the last row.
                w = known.whiten(x - known.centre)[:, ~known.flat]
                part = np.vstack([w.T @ w, w.sum(axis=0)]).ravel()
                sums[size] = sums.get(size, 0.0) + part
        for size, values in sums.items():
            yield pd.DataFrame({"size": size, "entry": np.arange(len(values)), "value": values})

    rows = (whole.select("size", "x").mapInPandas(add, "size int, entry long, value double")
            .groupBy("size", "entry").agg(F.sum("value").alias("value")).collect())
    errors = {size: float("nan") for size in fits}
    for size in {r["size"] for r in rows}:
        values = np.array([v for _, v in sorted((r["entry"], r["value"]) for r in rows
                                                if r["size"] == size)])
        side = int((~fits[size].flat).sum())
        moments = values.reshape(side + 1, side) / fits[size].n
        left = moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(side)
        errors[size] = float(np.abs(left).max())
    return errors


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector of
    ``vectors`` (vec_id, embedding) and each of its first ``components`` components.

    deviation is a decimal(38,0): the sum of (n * x - S)^2 outgrows a long with the number of rows.
    Vectors of each length have a fit of their own.  Null and empty vectors, and those with null or
    non-finite numbers, give no rows; numbers of 2^56 or more end the job with an error.  A component
    along which nothing varies has a null whitened value, and explained is null if nothing varies at
    all (one row, or all rows equal); identity_error is over the other components.  Rows without vec_id take part,
    repeated rows count as often as they come, an empty table gives an empty result, other columns
    are not looked at.
    """
    whole = stage(whole_vectors(vectors), "whole-vectors")
    fits = fit(whole, components)
    errors = identity_errors(whole, fits)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, index, x in _by_size(batch):
                known = fits[size]
                z = x - known.centre
                w = known.whiten(z)
                rest = np.array(known.rest, object)
                if np.abs(z).max() < _NARROW and known.n < 1 << 36:
                    rest = rest.astype(np.int64)
                else:
                    z = z.astype(object)
                said = [(float(v / known.trace) if known.trace > 0 else None) for v in known.values]
                yield pd.DataFrame({
                    "vec_id": batch.loc[index, "vec_id"].array, "n": known.n,
                    "square": [Decimal(int(v)) for v in (z * z).sum(axis=1)],
                    "cross": [Decimal(int(v)) for v in z @ rest],
                    "rests": Decimal(sum(r * r for r in known.rest)), "whitened": list(w),
                    "explained": [said] * len(w), "identity_error": errors[size]})

    n = F.col("n").cast("decimal(19,0)")
    deviation = n * (n * F.col("square") - 2 * F.col("cross")) + F.col("rests")
    # The id is text on its way through Python, which would make doubles of longs beside nulls.
    rows = whole.withColumn("vec_id", F.col("vec_id").cast("string")).mapInPandas(
        project, "vec_id string, n long, square decimal(38,0), cross decimal(38,0),"
                 " rests decimal(38,0), whitened array<double>, explained array<double>,"
                 " identity_error double")
    missing = F.lit(None).cast("double")
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), "n",
                        deviation.cast("decimal(38,0)").alias("deviation"), "identity_error",
                        F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "found"))
            .select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation",
                    F.nanvl("found.whitened", missing).alias("whitened"),
                    F.nanvl("found.explained", missing).alias("explained"),
                    F.nanvl("identity_error", missing).alias("identity_error")))
