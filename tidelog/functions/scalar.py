"""Scalar functions of the engine, as column expressions where they meet data."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.errors import InvalidRange

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def to_millis(ts: Column) -> Column:
    """A time cut to milliseconds, without a zone."""
    return F.date_trunc("millisecond", ts).cast("timestamp_ntz")


def increment_prefix(prefix: bytes) -> bytes:
    """The least byte string above all that begin with `prefix`; empty if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else b""


def check_range(start: str, end: str) -> None:
    """Bounds as bytes; the empty string means open."""
    if end and start.encode() > end.encode():
        raise InvalidRange(f"invalid range: {start!r} is above {end!r}")


def in_range(key: Column, start: str = "", end: str = "") -> Column:
    """start <= key < end, each bound only if it isn't empty."""
    check_range(start, end)
    out = F.lit(True)
    if start:
        out = out & (key >= start)
    if end:
        out = out & (key < end)
    return out


def place_in(value: Column, ascending: Column, *, below: bool = False) -> Column:
    """How many entries of an ascending array are at most `value`, or below it, by halving; arrays of fewer than 2**20 entries."""
    steps = F.transform(F.sequence(F.lit(19), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def step(at: Column, width: Column) -> Column:
        entry = F.get(ascending, at + width - 1)
        return F.when((at + width <= F.size(ascending)) & (entry < value if below else entry <= value), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def segment_name(created: Column) -> Column:
    """The file name that a segment's time of creation gives."""
    return F.concat(F.unix_millis(created.cast("timestamp")).cast("string"), F.lit(".sstable"))


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def number_text(value: float) -> str:
    """A JSON number as its shortest decimal text, with an exponent from 1e6 on and below 1e-4."""
    if value == int(value) and abs(value) < 1e6:
        return str(int(value)) if value or str(value)[0] != "-" else "-0"
    mantissa, _, exponent = f"{value!r}".partition("e")
    digits = mantissa.lstrip("-").replace(".", "").lstrip("0").rstrip("0")
    if not digits:
        return "0"
    power = int(f"{value:.17e}".partition("e")[2]) if not exponent else int(exponent)
    if -4 <= power < 6 and not exponent:
        return repr(value).removesuffix(".0")
    sign = "-" if value < 0 else ""
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if power < 0 else '+'}{abs(power):02d}"


def json_key(document: Column, field: str = "_id") -> Column:
    """The key of a JSON document: its text, true, false, or number, as number_text() writes it; else its JSON.

    Whether a value is text is asked of its JSON type at the top level, so neither nested fields nor text that looks like
    a number mislead.
    """
    raw = F.get_json_object(document, f"$.{field}")
    shown = F.get(F.from_json(F.concat(F.lit("["), document, F.lit("]")), f"array<struct<`{field}`: variant>>"), 0)[field]
    kind = F.schema_of_variant(shown)
    number = F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), raw.try_cast("double"))
    # Seventeen digits name every double; the fewest that read back as the same one are its text.
    tries = F.array(*[F.format_string(f"%.{d}e", number) for d in range(17)])
    least = F.element_at(F.filter(tries, lambda t: t.try_cast("double") == number), 1)
    sign, power = F.when(least.startswith("-"), "-").otherwise(""), F.regexp_extract(least, r"e([+-]\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(least, r"e.*$", ""), r"[-.]", ""), r"0+$", "")
    n = F.length(digits)
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    long_power = F.concat(F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
    exponent = F.when(F.abs(power) < 100, exponent).otherwise(long_power)
    scientific = F.concat(sign, F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(""), F.lit("e"), exponent)
    whole = F.concat(sign, F.rpad(digits, power + 1, "0"))
    pointed = F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(400)))
    below = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    zero = F.when(raw.startswith("-"), "-0").otherwise("0")
    small = (F.abs(number) < 1e6) & (number == F.floor(number))  # most keys; the tries are for the others
    text = F.when(number == 0, zero).when(small, number.cast("bigint").cast("string")).when((power < -4) | (power >= 6), scientific).when(power < 0, below).when(n <= power + 1, whole).otherwise(pointed)
    return F.when(number.isNull(), raw).otherwise(text)


def parse_time(text: str) -> datetime:
    """An RFC 3339 time, as a time without zone in UTC."""
    return datetime.fromisoformat(text).astimezone(timezone.utc).replace(tzinfo=None)
