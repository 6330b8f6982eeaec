"""Colour and contrast as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL_RATIO, LARGE_RATIO = 4.5, 3.0
LARGE_PT, LARGE_BOLD_PT = 18.0, 14.0


def digits(colour: Column) -> Column:
    """The six hex digits, or null for anything else."""
    bare = F.regexp_replace(colour, "^#+", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), bare)


def channel(colour: Column, k: int) -> Column:
    """Red, green or blue (0, 1, 2) from 0 to 255."""
    return F.conv(F.substring(digits(colour), 1 + 2 * k, 2), 16, 10).cast("int")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """Hex string of three shares, rounded half to even."""
    return F.format_string("#%02X%02X%02X", *(F.bround(x * 255, 0).cast("int") for x in (r, g, b)))


def is_large(size: Column, bold: Column) -> Column:
    return F.coalesce(size >= F.when(bold, LARGE_BOLD_PT).otherwise(LARGE_PT), F.lit(False))


def luminance(colour: Column) -> Column:
    def linear(k: int) -> Column:
        x = channel(colour, k) / 255
        return F.when(x <= 0.03928, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)


def ratio(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def required(size: Column, bold: Column) -> Column:
    return F.when(is_large(size, bold), LARGE_RATIO).otherwise(NORMAL_RATIO)


def passes(fg: Column, bg: Column, size: Column, bold: Column) -> Column:
    return ratio(fg, bg) >= required(size, bold)


def is_severe(fg: Column, bg: Column, ratio_: Column) -> Column:
    """Yellow on near-white below 1.5; malformed colours aren't."""
    yellow = (channel(fg, 0) >= 200) & (channel(fg, 1) >= 200) & (channel(fg, 2) < 100)
    white = (channel(bg, 0) >= 240) & (channel(bg, 1) >= 240) & (channel(bg, 2) >= 240)
    return F.coalesce(yellow & white & (ratio_ < 1.5), F.lit(False))


def from_int(value: Column) -> Column:
    """A packed colour as hex; 0 stands for none."""
    part = lambda n: F.shiftright(value, n).bitwiseAND(F.lit(255)).cast("int")
    return F.when(value != 0, F.format_string("#%02X%02X%02X", part(16), part(8), part(0)))
