"""Scalar functions: fixed-offset time zones, partition rollers, symbol codes and hashes, scaled integers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
OFFSETS = {"UTC": 0, "Asia/Shanghai": 28800, "Asia/Tokyo": 32400, "America/New_York": -18000}
HASH_START = 0xCBF29CE484222325
HASH_FACTOR = 0x1099511628211904


def tz_offset(name: str) -> int:
    """Seconds east of UTC. New York has no daylight saving time; other zones are +HHMM or -HHMM."""
    if name in OFFSETS:
        return OFFSETS[name]
    m = re.fullmatch(r"([+-])(\d\d)(\d\d).*", name)
    if not m:
        raise ValueError(f"unknown timezone: {name}")
    return (-1 if m[1] == "-" else 1) * (int(m[2]) * 3600 + int(m[3]) * 60)


def roll(ts_ns: Column, kind: str, tz: str = "UTC") -> Column:
    """The partition value of a timestamp: a date, hour or minute string. From days and seconds alone: the session's time zone plays no part."""
    seconds = _div(ts_ns, 1_000_000_000) + tz_offset(tz)
    day = _div(seconds, 86_400)
    second = seconds - day * 86_400
    parts = [F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")]
    if kind in ("hour", "minute"):
        parts.append(F.lpad(_div(second, 3600).cast("string"), 2, "0"))
    if kind == "minute":
        parts.append(F.lpad(_div(second % 3600, 60).cast("string"), 2, "0"))
    return F.concat_ws("-", *parts)


def _div(x: Column, by: int) -> Column:
    """Integer division that rounds down; doubles would lose nanoseconds."""
    r = F.pmod(x, F.lit(by).cast("long"))
    return F.call_function("div", x - r, F.lit(by).cast("long"))


def bucket(ts_ns: Column, interval_ns: int) -> Column:
    return _div(ts_ns, interval_ns)


def micros(ts_ns: Column) -> Column:
    return _div(ts_ns, 1000)


def scaled(value: Column, scale: Column) -> Column:
    return value / F.pow(F.lit(10.0), scale)


def payload_crc32(payload: Column) -> Column:
    return F.crc32(payload)


def key_values(payload: Column) -> Column:
    """A map from text of the form ``k=v k=v``."""
    return F.str_to_map(payload, F.lit(" "), F.lit("="))


def symbol_code(code: Column) -> Column:
    """Lower case; letters, digits, dot, underscore stay; separators become single inner dashes; the rest goes."""
    x = F.translate(code, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    x = F.regexp_replace(F.translate(x, "/: ", "---"), "[^a-z0-9._-]", "")
    return F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-|-$", "")


def hash64(text: str) -> int:
    h = HASH_START
    for b in text.encode():
        h = ((h ^ b) * HASH_FACTOR) & (2**64 - 1)
    return h


def symbol_hash(text: Column | str) -> Column:
    """hash64 as DECIMAL(20,0), a vectorised function: SQL integers can't wrap around at 64 bits."""
    from decimal import Decimal

    run = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else Decimal(hash64(x))), "decimal(20,0)", F.PandasUDFType.SCALAR)
    return run(text)


def market_id(text: Column | str) -> Column:
    """The upper half of hash64, exclusive-or the lower one."""
    run = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else (hash64(x) >> 32) ^ (hash64(x) & 0xFFFFFFFF)), "long", F.PandasUDFType.SCALAR)
    return run(text)


def version_id(symbol_id: Column, valid_from: Column, valid_until: Column) -> Column:
    return symbol_hash(F.concat_ws(":", symbol_id.cast("string"), valid_from.cast("string"), valid_until.cast("string")))


_COMPONENT = re.compile(r"[A-Za-z0-9._-]+")


def path_component(x: str) -> str:
    """A name that may be one part of a path."""
    if not _COMPONENT.fullmatch(x) or x in (".", ".."):
        raise ValueError(f"invalid path component: {x!r}")
    return x


def exchange_time(stamp: Column) -> Column:
    """Nanoseconds since the epoch of a 17-digit local time YYYYMMDDhhmmssSSS, taken as UTC; null if it is none."""
    text = stamp.cast("string")
    day = F.datediff(F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    part = lambda at, n: F.substring(text, at, n).cast("long")
    ms = ((day * 24 + part(9, 2)) * 60 + part(11, 2)) * 60 + part(13, 2)
    return F.when(text.rlike("^[0-9]{17}$"), (ms * 1000 + part(15, 3)) * 1_000_000)


def auction_phase(stamp: Column) -> Column:
    """open (09:15 to 09:25), close (14:57 to 15:00), continuous (09:30 to 11:30, 13:00 to 14:57) or closed, by the clock of a 17-digit time."""
    at = F.substring(stamp.cast("string"), 9, 4).cast("int")
    phase = F.when((at >= 915) & (at < 925), "open").when((at >= 1457) & (at < 1500), "close")
    return phase.when(((at >= 930) & (at < 1130)) | ((at >= 1300) & (at < 1457)), "continuous").otherwise("closed")
