"""Visit times from texts, dates and spreadsheet serial numbers, without any session time zone effect."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plausible spreadsheet day numbers (exclusive bounds) and the day number of 1970-01-01.
SERIAL_LOW = 10000
SERIAL_HIGH = 80000
SERIAL_EPOCH = 25569

YEAR_FIRST = r"^\d{4}\D+\d{1,2}\D+\d{1,2}"
YEAR_LAST = r"^\d{1,2}[./-]\s*\d{1,2}[./-]\s*\d{4}"
CLOCK = r"(?:[T\s]+\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)?\s*(?:Z|UTC)?$"
# Hours and minutes east of UTC behind a clock time.
OFFSET = r"(:\d{1,2}(?:\.\d+)?)\s*([+-])(\d{2}):?(\d{2})?$"
# A full time as programs write it.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?$"


def excel_serial(c: Column) -> Column:
    """Time of a spreadsheet day number, NULL outside the plausible range."""
    seconds = F.round((c - SERIAL_EPOCH) * 86400).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    clock = F.pmod(seconds, F.lit(86400))
    at = F.make_timestamp_ntz(
        F.year(day), F.month(day), F.day(day),
        F.floor(clock / 3600).cast("int"), F.floor(clock % 3600 / 60).cast("int"), clock % 60,
    )
    return F.when((c > SERIAL_LOW) & (c < SERIAL_HIGH), at)


def _with(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row, however often ``fn`` uses it."""
    return F.transform(F.array(value), lambda v: fn(v))[0]


def _time_of(text: Column, parts: Column) -> Column:
    def part(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("int")

    clock = [F.coalesce(part(i), F.lit(0)) for i in (3, 4, 5)]

    def at(year: int, month: int, day: int) -> Column:
        # Asking for month 13 costs an exception per row inside Spark.
        return F.when(part(month) <= 12, F.try_make_timestamp_ntz(part(year), part(month), part(day), *clock))

    return F.when(text.rlike(YEAR_FIRST + CLOCK), at(0, 1, 2)).when(
        text.rlike(YEAR_LAST + CLOCK), F.coalesce(at(2, 1, 0), at(2, 0, 1))
    )


def parse_datetime_text(c: Column) -> Column:
    """Time of a text: year-month-day, else day-month-year, else month-day-year; clock time optional.

    A time with an offset from UTC becomes UTC.
    """
    spaced = F.regexp_replace(F.trim(c.cast("string")), r"^(\d{4})(\d{2})(\d{2})(?!\d)", "$1-$2-$3")
    local = F.regexp_replace(spaced, OFFSET, "$1")
    at = _with(local, lambda text: _with(F.split(text, r"\D+"), lambda parts: _time_of(text, parts)))

    def part(i: int) -> Column:
        return F.regexp_extract(spaced, OFFSET, i)

    minutes = (part(3).try_cast("int") * 60 + F.coalesce(part(4).try_cast("int"), F.lit(0))) * F.when(part(2) == "-", -1).otherwise(1)
    shifted = at - F.make_dt_interval(mins=minutes)
    return F.when(spaced.rlike(OFFSET), shifted).otherwise(at)


def unparsed_times(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the number of known values and of those that give no time, in one pass."""
    counts = df.agg(*[F.struct(F.count(c).alias("n_known"), F.count_if(F.col(c).isNotNull() & parse_any_datetime(df, c).isNull())
                               .alias("n_unparsed")).alias(c) for c in columns])
    lines = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c)["n_known"].alias("n_known"),
                               F.col(c)["n_unparsed"].alias("n_unparsed")) for c in columns])
    return counts.select(F.explode(lines).alias("line")).select("line.*")


def parse_any_datetime(df: DataFrame, name: str) -> Column:
    """Time value of column ``name`` whatever its type."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return column
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return column.cast("timestamp_ntz")
    if isinstance(kind, T.NumericType):
        return excel_serial(column.cast("double"))
    return parse_datetime_text(column)
