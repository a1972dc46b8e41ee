"""Wall-clock and instant arithmetic.

Historical times are city wall-clock values. `ntz` keeps them zone-free;
`ltz` reads them in the session zone, so a clock change is part of a duration.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.schemas import CITY_ZONE, TIME_PATTERNS

_DATE_FIRST = r"^\d{4}-\d{2}-\d{2}"
_MONTH_FIRST = r"^\d{2}/\d{2}/\d{4}"
_CLOCK = r"\d{2}:\d{2}:\d{2}"
_FRACTION = r"\.\d{1,6}"
# One shape per accepted pattern, in the contract's order.
_SHAPES = (
    rf"{_MONTH_FIRST} {_CLOCK}{_FRACTION}$",
    rf"{_MONTH_FIRST} {_CLOCK}$",
    rf"{_DATE_FIRST} {_CLOCK}{_FRACTION}$",
    rf"{_DATE_FIRST} {_CLOCK}$",
    rf"{_DATE_FIRST}T{_CLOCK}{_FRACTION}$",
    rf"{_DATE_FIRST}T{_CLOCK}$",
)
_ANY_SHAPE = rf"(?:{_MONTH_FIRST} |{_DATE_FIRST}[ T]){_CLOCK}(?:{_FRACTION})?$"


def parse_wall_clock(text: Column, wall_clock="ltz") -> Column:
    """Timestamp for any of the six accepted shapes, else NULL.

    One shape test and one cast instead of six formatter attempts: a failed
    formatter attempt raises inside the JVM for every row and pattern.
    """
    kind = {"ltz": "timestamp", "ntz": "timestamp_ntz"}[wall_clock]
    # The six shapes differ from the cast's own input only in the order of the date fields.
    dashed = F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4})", "$3-$1-$2")
    return F.when(text.rlike(_ANY_SHAPE), dashed.try_cast(kind))


def matched_pattern(text: Column) -> Column:
    """The accepted pattern that the text follows, NULL when it is not a time."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for shape, pattern in zip(_SHAPES, TIME_PATTERNS):
        chain = chain.when(text.rlike(shape), F.lit(pattern))
    return F.when(parse_wall_clock(text, "ntz").isNotNull(), chain)


def elapsed_seconds(df, start, end) -> Column:
    """Whole seconds between two timestamp columns, rounded down also below zero.

    Zone-free columns differ by their wall clocks; subtracting zoned ones would do
    the same, so those are compared as instants.
    """
    if isinstance(df.schema[start].dataType, T.TimestampNTZType):
        seconds = (F.col(end) - F.col(start)).cast(T.DayTimeIntervalType(3, 3)).cast("decimal(20,6)")
    else:
        seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1000000
    return F.floor(seconds).cast("long")


def iso_day(when: Column) -> Column:
    """Monday 1 … Sunday 7."""
    return (F.weekday(when) + 1).cast("tinyint")


def hour_of(when: Column) -> Column:
    return F.hour(when).cast("tinyint")


def with_calendar(df, when, date="service_date", hour="start_hour", day="day_of_week", weekend="is_weekend"):
    """Calendar columns of a wall-clock timestamp."""
    return df.withColumns(
        {
            date: F.to_date(when),
            hour: hour_of(F.col(when)),
            day: iso_day(F.col(when)),
            weekend: iso_day(F.col(when)) >= 6,
        }
    )


def city_clock(df, instant) -> Column:
    """City wall clock of a UTC instant column: TIMESTAMP, or TIMESTAMP_NTZ holding UTC."""
    if isinstance(df.schema[instant].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.lit(CITY_ZONE), F.col(instant))
    return F.convert_timezone(
        F.current_timezone(), F.lit(CITY_ZONE), F.col(instant).cast("timestamp_ntz")
    )


def plus_seconds(when: Column, seconds: int) -> Column:
    return when + F.expr(f"INTERVAL {int(seconds)} SECOND")


def utc_wall(df, instant) -> Column:
    """UTC wall clock of an instant column, zone-free."""
    if isinstance(df.schema[instant].dataType, T.TimestampNTZType):
        return F.col(instant)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(instant).cast("timestamp_ntz"))


def _iso(wall: Column) -> Column:
    return F.replace(wall.cast("string"), F.lit(" "), F.lit("T"))


def utc_text(df, instant) -> Column:
    """RFC 3339 text in UTC, fractions only when present."""
    return F.concat(_iso(utc_wall(df, instant)), F.lit("Z"))


def city_text(df, instant) -> Column:
    """RFC 3339 text on the city's clock with its offset at that instant."""
    city, utc = city_clock(df, instant), utc_wall(df, instant)
    minutes = ((city - utc).cast(T.DayTimeIntervalType(2, 2))).cast("int")
    size = F.abs(minutes)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    offset = F.concat(two(F.floor(size / 60)), F.lit(":"), two(size % 60))
    return F.concat(_iso(city), F.when(minutes < 0, "-").otherwise("+"), offset)


def sortable(df, column) -> Column:
    """A BIGINT that orders like the timestamp, so newest-first fits in an ascending struct."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        second = F.expr(f"CAST(extract(SECOND FROM `{column}`) * 1000000 AS BIGINT)")
        minutes = F.unix_date(F.to_date(column)).cast("long") * 1440 + F.hour(column) * 60 + F.minute(column)
        return minutes * 60000000 + second
    return F.unix_micros(column)
