"""Time, rate and byte text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wall_time(ms: Column) -> Column:
    """Wall-clock milliseconds as TIMESTAMP (for windows and partition dates)."""
    return F.timestamp_micros((ms * 1000).cast("bigint"))


def format_time(ms: Column, zone: str = "UTC") -> Column:
    """Wall-clock milliseconds as ``YYYY-MM-DD HH:MM:SS.mmm`` in ``zone``.

    Computed on zone-less timestamps, so the text does not follow the session's
    time zone setting.
    """
    whole = ms.try_cast("bigint")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = F.timestamp_add("MILLISECOND", whole, epoch)
    if zone != "UTC":
        moment = F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSS")


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def format_rate(kind: Column, value: Column) -> Column:
    """A sampled value with its unit: plain count, or B/s, kB/s, MB/s by 1024."""
    rate = (
        F.when(value >= 1048576.0, F.concat(_fixed(value / 1048576.0, 1), F.lit(" MB/s")))
        .when(value >= 1024.0, F.concat(_fixed(value / 1024.0, 1), F.lit(" kB/s")))
        .otherwise(F.concat(_fixed(value, 0), F.lit(" B/s")))
    )
    return F.when(kind == "count", _fixed(value, 0)).otherwise(rate)


def searchable_bytes(base64_text: Column) -> Column:
    """Printable ASCII of base64 data: 0 becomes a blank, other bytes "."; NULL if not base64."""
    data = F.try_to_binary(base64_text, F.lit("base64"))
    latin = F.decode(data, "ISO-8859-1")
    return F.concat(F.lit(" "), F.regexp_replace(F.translate(latin, "\x00", " "), r"[^\x20-\x7E]", "."))


def hex_bytes(base64_text: Column) -> Column:
    """Base64 data as upper-case hex octets separated by blanks; NULL if not base64."""
    data = F.try_to_binary(base64_text, F.lit("base64"))
    return F.rtrim(F.regexp_replace(F.hex(data), "(..)", "$1 "))
