"""Date, time and interval functions.  Intervals are structs (months, days, micros), as their parts compare and print apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.struct(lit(months).cast("bigint").alias("months"), lit(days).cast("bigint").alias("days"), lit(micros).cast("bigint").alias("micros"))


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, mins=0, secs=0.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return interval(lit(years) * 12 + lit(months), lit(weeks) * 7 + lit(days), ((lit(hours) * 60 + lit(mins)) * 60).cast("bigint") * 1_000_000 + F.round(lit(secs) * 1_000_000).cast("bigint"))


def interval_key(i: Column) -> Column:
    """Total microseconds with 30-day months: the order and equality of intervals."""
    return (i["months"] * 30 + i["days"]) * DAY + i["micros"]


def _quotient(a: Column, n: int) -> Column:
    return (F.sign(a) * F.floor(F.abs(a) / n)).cast("bigint")


def justify_days(i: Column) -> Column:
    q = _quotient(i["days"], 30)
    m, d = i["months"] + q, i["days"] - q * 30
    return interval(F.when((m > 0) & (d < 0), m - 1).when((m < 0) & (d > 0), m + 1).otherwise(m), F.when((m > 0) & (d < 0), d + 30).when((m < 0) & (d > 0), d - 30).otherwise(d), i["micros"])


def justify_hours(i: Column) -> Column:
    q = _quotient(i["micros"], DAY)
    d, u = i["days"] + q, i["micros"] - q * DAY
    return interval(i["months"], F.when((d > 0) & (u < 0), d - 1).when((d < 0) & (u > 0), d + 1).otherwise(d), F.when((d > 0) & (u < 0), u + DAY).when((d < 0) & (u > 0), u - DAY).otherwise(u))


def justify_interval(i: Column) -> Column:
    return justify_days(justify_hours(i))


def add_interval(ts: Column, i: Column) -> Column:
    """timestamp + interval: months first (clamped to the month's end), then days, then time."""
    return F.timestamp_add("MICROSECOND", i["micros"], F.timestamp_add("DAY", i["days"].cast("int"), F.timestamp_add("MONTH", i["months"].cast("int"), ts)))


def age(end: Column, start: Column) -> Column:
    """AGE(end, start): whole months, then days, then time; the sign is the same in all parts."""
    back = end < start
    a, b = F.when(back, end).otherwise(start), F.when(back, start).otherwise(end)
    months = F.floor(F.months_between(b, a)).cast("int")
    at = F.timestamp_add("MONTH", months, a)
    fix = at > b
    months = F.when(fix, months - 1).otherwise(months)
    at = F.timestamp_add("MONTH", months, a)
    micros = F.timestamp_diff("MICROSECOND", at, b)
    sign = F.when(back, -1).otherwise(1)
    return interval(months * sign, F.floor(micros / DAY).cast("bigint") * sign, (micros % DAY) * sign)


def date_part(field: str, ts: Column) -> Column:
    """EXTRACT(field FROM ts) as a double; dow counts from Sunday = 0."""
    simple = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "quarter": F.quarter, "doy": F.dayofyear, "week": F.weekofyear}
    if field in simple:
        return simple[field](ts).cast("double")
    sec = F.extract(F.lit("SECOND"), ts).cast("double")
    other = {
        "second": lambda: sec,
        "milliseconds": lambda: sec * 1000,
        "microseconds": lambda: sec * 1_000_000,
        "dow": lambda: (F.dayofweek(ts) - 1).cast("double"),
        "isodow": lambda: ((F.dayofweek(ts) + 5) % 7 + 1).cast("double"),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts).cast("double"),
        "century": lambda: F.ceil(F.year(ts) / 100).cast("double"),
        "decade": lambda: F.floor(F.year(ts) / 10).cast("double"),
        "millennium": lambda: F.ceil(F.year(ts) / 1000).cast("double"),
        "epoch": lambda: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1_000_000,
    }
    if field not in other:
        raise ValueError(f"unit {field!r} not recognized")
    return other[field]()


def date_trunc(field: str, ts: Column) -> Column:
    return F.date_trunc(field, ts)


def date_bin(stride_micros: int, ts: Column, origin: str) -> Column:
    """DATE_BIN: ts down to the start of its bin, aligned to origin."""
    if stride_micros <= 0:
        raise ValueError("stride must be greater than zero")
    o = F.lit(origin).cast("timestamp_ntz")
    off = F.timestamp_diff("MICROSECOND", o, ts.cast("timestamp_ntz"))
    return F.timestamp_add("MICROSECOND", off - F.pmod(off, F.lit(stride_micros)), o)


#: Template patterns and the formatter's letters for them, longest first.
_PATTERNS = (
    ("YYYY", "yyyy"), ("MONTH", None), ("Month", "MMMM"), ("Mon", "MMM"), ("HH24", "HH"), ("HH12", "hh"), ("DDD", "DDD"), ("YY", "yy"),
    ("MM", "MM"), ("DD", "dd"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Dy", "EEE"), ("Q", "Q"),
)


def template(fmt: str) -> str:
    """A to_char template as a Spark datetime pattern; unknown letters are literals."""
    out, i = [], 0
    while i < len(fmt):
        for name, letters in _PATTERNS:
            if letters and fmt.startswith(name, i):
                out.append(letters)
                i += len(name)
                break
        else:
            c = fmt[i]
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            i += 1
    return "".join(out)


def to_char(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, template(fmt))


def to_date(s: Column, fmt: str) -> Column:
    return F.to_date(s, template(fmt))


def to_timestamp(s: Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(s, F.lit(template(fmt)))


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp_ntz(y, mo, d, h, mi, s)
