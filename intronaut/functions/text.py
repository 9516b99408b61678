"""Small helpers for texts that are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    """The text without line breaks."""
    return F.regexp_replace(text, r"[\r\n]", "")


def tagged(text: Column, tag: str) -> Column:
    return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))


def untagged(text: Column) -> Column:
    """The text without markup tags."""
    return F.regexp_replace(text, "<[^>]*>", "")


def with_break(text: Column, width: int = 6) -> Column:
    """The first ``width`` characters and the rest on a further line."""
    return F.concat(F.substring(text, 1, width), F.lit("\n"), F.substring(text, width + 1, 1 << 30))


def number(x: Column) -> Column:
    """A double as text with its shortest digits: plain from 1e-4 to 1e16, else as ``1.2e-05``. Spark's own cast goes over to ``E`` outside 1e-3 to 1e7."""
    own = x.cast("string")
    power = F.split_part(own, F.lit("E"), F.lit(2)).cast("int")
    digits = F.regexp_replace(F.split_part(own, F.lit("E"), F.lit(1)), r"\.0$", "")
    small = F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    # a large power is of three digits, which lpad would cut
    small = F.when(F.abs(power) < 100, small).otherwise(F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string")))
    plain = F.regexp_replace(F.regexp_replace(own.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(~own.contains("E"), own).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), plain).otherwise(small)
