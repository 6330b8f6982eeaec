"""Contrast repair: the least change of lightness that reaches the needed ratio, on whole columns at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.shipping import ship

MARGIN = 0.05
STEPS = 30


def channels(colours: pd.Series) -> np.ndarray:
    """Red, green and blue from 0 to 1, a row for each colour."""
    return np.array([[int(c[k : k + 2], 16) for k in (1, 3, 5)] for c in colours.str.rjust(7, "#")], float).reshape(-1, 3) / 255


def luminance(rgb: np.ndarray) -> np.ndarray:
    linear = np.where(rgb <= 0.03928, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    return linear @ np.array([0.2126, 0.7152, 0.0722])


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of luminances."""
    return (np.maximum(a, b) + 0.05) / (np.minimum(a, b) + 0.05)


def with_lightness(light: np.ndarray, hue: np.ndarray, saturation: np.ndarray) -> np.ndarray:
    """Each channel is a ramp around its third of the circle of hues."""
    top = np.where(light <= 0.5, light * (1 + saturation), light + saturation - light * saturation)
    low = 2 * light - top
    out = []
    for turn in (1 / 3, 0.0, -1 / 3):
        h = (hue + turn) % 1.0
        out.append(np.where(h < 1 / 6, low + (top - low) * h * 6, np.where(h < 0.5, top, np.where(h < 2 / 3, low + (top - low) * (2 / 3 - h) * 6, low))))
    return np.where(saturation == 0, light, np.array(out)).T


def darkened(fg: pd.Series, bg: pd.Series, need: np.ndarray) -> pd.Series:
    """fg with the highest lightness at which the ratio reaches need plus the margin; fg itself if none does or it already passes."""
    rgb, ground = channels(fg), luminance(channels(bg))
    most, least = rgb.max(axis=1), rgb.min(axis=1)
    span, top = most - least, (most + least) / 2
    some = np.where(span == 0, 1.0, span)
    saturation = np.where(span == 0, 0.0, span / np.where(top <= 0.5, np.maximum(most + least, 1e-300), np.where(span == 0, 1.0, 2 - most - least)))
    r, g, b = rgb.T
    hue = np.where(span == 0, 0.0, np.where(r == most, (g - b) / some, np.where(g == most, 2 + (b - r) / some, 4 + (r - g) / some)) / 6 % 1.0)
    low, best = np.zeros(len(top)), np.full(len(top), np.nan)
    for _ in range(STEPS):
        mid = (low + top) / 2
        good = ratio(luminance(with_lightness(mid, hue, saturation)), ground) >= need + MARGIN
        low, top, best = np.where(good, mid, low), np.where(good, top, mid), np.where(good, mid, best)
    stays = (ratio(luminance(rgb), ground) >= need) | np.isnan(best)
    codes = np.rint(with_lightness(np.nan_to_num(best), hue, saturation) * 255).astype(int)
    return fg.where(stays, ["#%02X%02X%02X" % tuple(c) for c in codes])


def repaired(fg: str, bg: str, size: str, bold: str) -> Column:
    """Column of repaired foregrounds."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(f: pd.Series, b: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        return darkened(f, b, np.where(s >= np.where(k, 14, 18), 3.0, 4.5))

    return run(F.col(fg), F.col(bg), F.col(size), F.col(bold))
