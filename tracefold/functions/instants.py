"""Times recorded as text, read as one UTC instant in microseconds.

Everything is a Catalyst expression, so parsing stays in the JVM. Each notation
is rewritten once to a common form (year|month|day|hour|minute|second|fraction|
half|zone) and the parts are then checked together.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations with their offsets in minutes, and month names.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "JST": 540}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"

_ZONE = r"(?:[ ]*(Z|UTC|GMT|CET|CEST|EST|EDT|JST|[+-][0-9]{2}(?::?[0-9]{2})?))?(?:[ ]*\[[^\]]*\])?"
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?"
_HALF = r"(?:[ ]*(AM|PM))?"
#: pattern and the places of year, month, day, hour, minute, second, fraction, half, zone (0: not there)
_NOTATIONS = [
    (rf"(?i)^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:(?:T|[ ]+){_CLOCK}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"(?i)^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})T([0-9]{{2}}):?([0-9]{{2}})(?::?([0-9]{{2}})(?:[.,]([0-9]+))?)?{_ZONE}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    (rf"(?i)^(?:[a-z]{{3,9}},?[ ]+)?([0-9]{{1,2}})[ -]([a-z]{{3}})[a-z]*[ -]([0-9]{{4}})[ ]+{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"(?i)^([0-9]{{1,2}})/([a-z]{{3}})/([0-9]{{4}}):{_CLOCK}{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"(?i)^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}})(?:(?:,?[ ]+|T){_CLOCK}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    (rf"(?i)^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})(?:,?[ ]+{_CLOCK}{_HALF}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9)),
]
_NUMBER = r"^[0-9]{1,19}(?:\.[0-9]+)?$"


def _int(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(c).try_cast("int")


def tidy(raw: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(raw, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")


def known_zones() -> str:
    """Names that are zones, as a list of SQL strings; any other name would be an error in the JVM."""
    return ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))


def _number_us(t: Column) -> Column:
    """Seconds, milliseconds, microseconds or nanoseconds: whichever unit lands near 2025."""
    whole = F.regexp_extract(t, r"^([0-9]+)", 1)
    frac = F.regexp_extract(t, r"\.([0-9]+)$", 1)
    n = whole.try_cast("long")
    digits = F.length(F.regexp_replace(whole, "^0+", ""))

    def unit(shift: int) -> Column:
        # 10**shift microseconds each; the fraction fills the digits below
        return n * F.lit(10**shift) + F.substring(F.rpad(frac, shift, "0"), 1, shift).cast("long")

    return (
        F.when(digits <= 11, unit(6))
        .when(digits <= 14, unit(3))
        .when(digits <= 17, n)
        .otherwise(F.call_function("div", n, F.lit(1000)))
    )


def with_instant(df: DataFrame, raw: Column, zone: Column, out: str) -> DataFrame:
    """``df`` with ``out``: microseconds since 1970 UTC of a recorded time, NULL where it is unreadable.

    ``zone`` is the zone of the recording machine, used for wall times; NULL or
    an unknown name counts as UTC. A wall time that occurs twice is its first
    occurrence, a skipped one moves on by the length of the skip. The work is
    laid out as a few projections, so that no part is computed twice.
    """
    keep = df.columns
    tag = f"__{out}_"
    c = lambda n: F.col(f"`{tag}{n}`")
    df = df.withColumns({tag + "t": tidy(raw), tag + "zone": zone})
    parts = F.lit(None).cast("string")
    for pattern, at in reversed(_NOTATIONS):
        # \x01 separates the parts: a control character that no pattern lets through
        parts = F.when(c("t").rlike(pattern), F.regexp_replace(c("t"), pattern, "\x01".join(f"${k}" if k else "" for k in at))).otherwise(parts)
    df = df.withColumn(tag + "p", F.split(parts, "\x01"))
    names = F.array(*map(F.lit, MONTHS))
    df = df.withColumns(
        {tag + n: _int(c("p")[i]) for i, n in ((0, "y"), (2, "d"), (3, "h"), (4, "mi"), (5, "s"))}
        | {
            tag + "m": F.when(c("p")[1].rlike("^[0-9]"), _int(c("p")[1])).otherwise(F.array_position(names, F.lower(c("p")[1])).cast("int")),
            tag + "f": F.rpad(F.substring(c("p")[6], 1, 6), 6, "0"),
            tag + "half": F.upper(c("p")[7]),
            tag + "off": F.regexp_replace(F.upper(c("p")[8]), ":", ""),
            tag + "n": F.when(c("t").rlike(_NUMBER), _number_us(c("t"))),
        }
    )
    y, m, d, h, mi, sec, half, off = (c(n) for n in ("y", "m", "d", "h", "mi", "s", "half", "off"))
    good = (y >= 1) & (sec <= 59) & ((half == "") | h.between(1, 12))
    hour = F.when(half == "", h).otherwise(h % 12 + F.when(half == "PM", 12).otherwise(0))
    exact = F.concat(sec.cast("string"), F.lit("."), c("f")).try_cast("decimal(16,6)")
    wall = F.try_make_timestamp(y, m, d, hour, mi, exact, F.lit("UTC"))
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    hh, mins = F.substring(off, 2, 2).try_cast("int"), F.coalesce(F.substring(off, 4, 2).try_cast("int"), F.lit(0))
    minutes = F.when(off.rlike("^[A-Z]"), F.try_element_at(named, off)).when((hh <= 23) & (mins <= 59), (hh * 60 + mins) * F.when(off.startswith("-"), -1).otherwise(1))
    df = df.withColumns(
        {
            tag + "wall": F.when(good, wall),
            tag + "min": minutes,
            tag + "known": F.expr(f"if(`{tag}zone` in ({known_zones()}), `{tag}zone`, 'UTC')"),
        }
    )
    local = F.unix_micros(F.to_utc_timestamp(c("wall"), c("known")))
    us = F.coalesce(c("n"), F.when(off == "", local).otherwise(F.unix_micros(c("wall")) - c("min").cast("long") * F.lit(60000000)))
    # A filter on the result would be pushed below all these projections, each use of a part then
    # repeating all of its work. A non-deterministic condition, always true, stops that.
    return df.select(*(F.col(f"`{k}`") for k in keep), F.when(F.monotonically_increasing_id() >= 0, us).alias(out))


def zone_of(log_extensions: Column) -> Column:
    """The recording machine's zone from an import's extensions, NULL if there is none."""
    return F.get_json_object(log_extensions, "$._timeZone")
