"""Years, timestamps and durations from messy values. Nothing here throws on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def best_year(value: Column) -> Column:
    """The first run of three or four digits in a string, if between 300 and 2100."""
    year = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"\b(\d{3,4})\b", 1).try_cast("int")
    return F.when(year.between(300, 2100), year)


def year_range(value: Column) -> Column:
    """(year_min, year_max): decades, ranges whose second year may have two digits, else all four-digit years."""
    text = F.coalesce(value, F.lit(""))
    decade = F.regexp_extract(text, r"\b(\d{3}0)s\b", 1).try_cast("int")
    first = F.regexp_extract(text, r"\b(\d{4})\s*[-–/]\s*(\d{2,4})\b", 1).try_cast("int")
    second = F.regexp_extract(text, r"\b(\d{4})\s*[-–/]\s*(\d{2,4})\b", 2).try_cast("int")
    carried = F.when(second < 100, F.floor(first / 100).cast("int") * 100 + second).otherwise(second)
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1)), lambda y: y.try_cast("int"))
    low = F.when(decade.isNotNull(), decade).when(first.isNotNull(), first).otherwise(F.array_min(years))
    high = F.when(decade.isNotNull(), decade + 9).when(first.isNotNull(), F.greatest(first, carried)).otherwise(F.array_max(years))
    return F.struct(low.alias("year_min"), high.alias("year_max"))


def matching_year(value: Column) -> Column:
    """A year from 1000 to 2099."""
    return F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"\b(1\d{3}|20\d{2})\b", 1).try_cast("int")


def parenthetical_year(title: Column) -> Column:
    return F.regexp_extract(F.coalesce(title, F.lit("")), r"\((1\d{3}|20\d{2})\)", 1).try_cast("int")


def lenient_timestamp(value: Column) -> Column:
    """Seconds since the epoch or ISO 8601, without a zone UTC; else null."""
    text = F.trim(value.cast("string"))
    seconds = text.try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.try_to_timestamp(text))


def duration_ms(started: Column, ended: Column) -> Column:
    """Milliseconds between two moments; null if the end comes first."""
    ms = F.unix_millis(ended) - F.unix_millis(started)
    return F.when(ms >= 0, ms)


def is_live(ts: Column, now: Column, days: int) -> Column:
    """Whether a record is younger than days; records without a readable time aren't."""
    return F.coalesce(lenient_timestamp(ts) >= now - F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(False))


def overdue_days(due: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, due), F.lit(0))


def lifespan(born: Column, died: Column) -> Column:
    """years of two claims as born-died; an unknown end stays open."""
    first, last = (F.regexp_extract(F.coalesce(c, F.lit("")), r"\+?(\d{4})", 1) for c in (born, died))
    return F.when((first != "") | (last != ""), F.concat_ws("-", first, last))


def slot_start(ts: Column, seconds: int) -> Column:
    """The start of the tumbling clock window that holds ts, as epoch seconds."""
    return F.floor(F.unix_seconds(ts) / seconds) * seconds
