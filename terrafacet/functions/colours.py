"""Colours of values as integers 0xRRGGBB and as text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ramp from low to high, and the colour of values without a place on it.
RAMP = [0x002DD0, 0x005BA2, 0x008C73, 0x00B944, 0x00E716, 0xA0FF00, 0xFFFF00, 0xFFC814, 0xFFA000, 0xFF5B00, 0xFF0000]
NONE = 0xFFFFFF


def blend(t: Column, start: Column, end: Column) -> Column:
    """A colour between two, each channel in proportion and cut to a whole number."""

    def channel(shift: int) -> Column:
        a, b = (F.shiftright(c, shift).bitwiseAND(F.lit(255)) for c in (start, end))
        return F.shiftleft(F.floor(a * (1 - t) + b * t).cast("int"), shift)

    return channel(16).bitwiseOR(channel(8)).bitwiseOR(channel(0))


def linear(value: Column, low: Column, high: Column, start: int, end: int) -> Column:
    """A colour between two at a value's place between low and high."""
    return blend((value - low) / (high - low), F.lit(start), F.lit(end))


def ramp(value: Column, low: Column, high: Column) -> Column:
    """The ramp's colour at a value's place between low and high; NONE outside and for no value."""
    steps = len(RAMP) - 1
    at = (value - low) / (high - low) * steps
    k = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    colours = F.array(*map(F.lit, RAMP))
    held = value.isNotNull() & ~F.isnan(value) & value.between(low, high) & (high > low)
    return F.when(held, blend(at - k, F.get(colours, k), F.get(colours, k + 1))).otherwise(NONE)


def rgb_text(colour: Column) -> Column:
    """A colour's red, green and blue, joined by commas."""
    return F.concat_ws(",", *(F.shiftright(colour, s).bitwiseAND(F.lit(255)).cast("string") for s in (16, 8, 0)))
