"""Colours and ids as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def segment_id_to_rgb(segment: Column) -> tuple[Column, Column, Column]:
    """Bit i (0..23) of an id goes to channel i mod 3 (r, g, b) at bit 7 - i div 3."""
    bit = lambda i: F.shiftleft(F.shiftright(segment, i).bitwiseAND(1), 7 - i // 3)
    return tuple(_sum([bit(i) for i in range(c, 24, 3)]).cast("int") for c in range(3))


def rgb_to_segment_id(r: Column, g: Column, b: Column) -> Column:
    """Inverse of segment_id_to_rgb."""
    channel = (r, g, b)
    return _sum([F.shiftleft(F.shiftright(channel[i % 3], 7 - i // 3).bitwiseAND(1), i) for i in range(24)]).cast("int")


def color_key(r: Column, g: Column, b: Column) -> Column:
    """One number for a colour."""
    return r * 1_000_000 + g * 1000 + b


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB to CIE-Lab (D65) in 8 bits: L * 255 / 100, a + 128, b + 128, rounded."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    root = lambda t: F.when(t > 0.008856, F.pow(t, 1.0 / 3)).otherwise(7.787 * t + 16.0 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, 1.0 / 3) - 16).otherwise(903.3 * y)
    whole = lambda v: F.round(v).cast("int")
    return whole(light * 2.55), whole(500 * (root(x) - root(y)) + 128), whole(200 * (root(y) - root(z)) + 128)
