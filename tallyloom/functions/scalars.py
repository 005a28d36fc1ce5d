"""Shared scalar expressions: time, decay, logarithmic shares, text helpers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
SECONDS_PER_DAY = 86_400
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# A leading full date; keeps the lenient SQL cast from accepting "2024" alone.
_FULL_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def moment(as_of: str | datetime | Column) -> Column:
    """The point in time a score is taken at, as a timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of.isoformat() if isinstance(as_of, datetime) else as_of
    return F.to_timestamp(F.lit(text))


def parse_iso(text: Column) -> Column:
    """ISO text to timestamp; ``Z`` and offsets honoured, naive text is UTC, junk is null."""
    return F.when(text.rlike(_FULL_DATE), F.try_to_timestamp(text))


def parse_due(text: Column) -> Column:
    """Like :func:`parse_iso`, but a bare date means the last second of that day."""
    end_of_day = F.try_to_timestamp(F.concat(text, F.lit(" 23:59:59")))
    return F.when(text.rlike(_DATE_ONLY), end_of_day).otherwise(parse_iso(text))


def elapsed_days(as_of, ts: Column) -> Column:
    """Fractional days from ``ts`` to ``as_of``; negative when ``ts`` lies ahead."""
    micros = F.unix_micros(moment(as_of)) - F.unix_micros(ts)
    return micros / F.lit(float(MICROS_PER_SECOND * SECONDS_PER_DAY))


def elapsed_hours(as_of, ts: Column) -> Column:
    micros = F.unix_micros(moment(as_of)) - F.unix_micros(ts)
    return micros / F.lit(3_600.0 * MICROS_PER_SECOND)


def decay(days: Column, rate: float, weight: float = 1.0) -> Column:
    """``weight * exp(-rate * days)``; no date means no credit, the future is not clamped."""
    return F.coalesce(F.lit(weight) * F.exp(F.lit(-rate) * days), F.lit(0.0))


def log_share(count: Column, largest: Column) -> Column:
    """``ln(1+count) / ln(1+largest)``, zero when the largest count is zero."""
    return F.coalesce(F.log1p(count) / F.nullif(F.log1p(largest), F.lit(0.0)), F.lit(0.0))


def with_maxima(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``_top``: the dataset-wide maxima of the columns, as one struct.

    One uncorrelated scalar subquery: a single row reaches the main plan, whatever the data
    size, no join is involved, and the shuffles both sides share run once.
    """
    fields = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in columns]
    return df.withColumn("_top", df.agg(F.struct(*fields).alias("top")).scalar())


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def present(text: Column) -> Column:
    """True for non-null, non-empty text."""
    return ~is_blank(text)


def present_json(text: Column) -> Column:
    """True for JSON text that holds something: not null, empty, false or zero."""
    return present(text) & ~F.trim(text).isin("{}", "[]", "null", "false", "0", '""')


def present_id(identifier: Column) -> Column:
    """True for an identifier that is neither null, empty nor zero."""
    return identifier.isNotNull() & ~identifier.cast("string").isin("", "0")


def array_length(values: Column) -> Column:
    return F.greatest(F.coalesce(F.size(values), F.lit(0)), F.lit(0)).cast("long")


def shorten(text: Column, length: int) -> Column:
    """First ``length`` characters, with an ellipsis when something was left out."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("...")))\
        .otherwise(text)


def per_item(total: Column, items: Column, digits: int) -> Column:
    """Rounded average with the divisor kept at one or more."""
    return F.round(total / F.greatest(items, F.lit(1)), digits)


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def clamp_sample_size(n: int, low: int = 2, high: int = 5) -> int:
    return max(low, min(n, high))
