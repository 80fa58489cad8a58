"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_shape(arg: Column) -> Column:
    """'NAME:d1,d2' as struct(name, dims); empty parts are skipped. Other forms raise."""
    name = F.split(arg, ":")[0]
    parts = F.filter(F.split(F.substring_index(arg, ":", -1), ","), lambda p: F.trim(p) != "")
    bad = ~arg.contains(":") | (F.size(parts) == 0) | F.exists(parts, lambda p: ~p.rlike(r"^\s*-?\d+\s*$"))
    dims = F.transform(parts, lambda p: F.try_to_number(F.trim(p), F.lit("S9999999999")).cast("int"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not NAME:d1,d2: "), arg)).cast("array<int>")).otherwise(dims)
    return F.struct(name.alias("name"), checked.alias("dims"))


def image_size(imgsz: Column, default: Column, enforce: Column, divisor: Column) -> Column:
    """No size: the default; an enforced size: the default; else the multiple of the divisor below, at least one of it."""
    multiple = F.greatest((imgsz / divisor).cast("int"), F.lit(1)) * divisor
    return F.when(imgsz.isNull() | enforce, default).otherwise(F.when(divisor.isNotNull(), multiple).otherwise(imgsz))


def input_shape(kind: Column, batch: Column, size: Column) -> Column:
    """The shape of an 'image' or 'size' input; another kind raises."""
    return F.when(kind == "image", F.array(batch, F.lit(3), size, size)).when(kind == "size", F.array(batch, F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("unknown input kind "), kind)).cast("array<int>"))


def seconds_to_ms(x: Column) -> Column:
    return x * 1000


def milli_to_unit(x: Column) -> Column:
    return x / 1000


def rounded_ms(seconds: Column) -> Column:
    """Milliseconds with two decimals, halves to even."""
    return F.bround(seconds * 1000, 2)


def percent_difference(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / b * 100).otherwise(0.0)


def override(own: Column, default: Column) -> Column:
    """A setting of one engine, else the common one. Only null falls back, not 0."""
    return F.coalesce(own, default)
