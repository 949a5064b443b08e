"""Page and box arithmetic, schedules and buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the standard, in millimetres: width of 44 characters at their pitch.
PITCH_MM = 2.54
LINE_MM = 44 * PITCH_MM


def mm_to_px(mm: Column, dpi: Column) -> Column:
    return mm * dpi / 25.4


def px_to_mm(px: Column, dpi: Column) -> Column:
    return px * 25.4 / dpi


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("x"), top.alias("y"), width.alias("width"), height.alias("height"))


def default_box(width: Column, height: Column) -> Column:
    """The whole of an image more than five times as wide as high, else its lowest 34 hundredths."""
    w, h = width.cast("double"), height.cast("double")
    strip = w > 5 * h
    return box(F.lit(0.0), F.when(strip, 0.0).otherwise(h * 0.66), w, F.when(strip, h).otherwise(h * 0.34))


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, least: int = 8) -> Column:
    """struct(left, top, right, bottom) in whole pixels inside the image, rounded half to even; null if a side is under `least`."""
    edge = lambda v, most: F.greatest(F.lit(0), F.least(F.bround(v, 0).cast("int"), most)).cast("int")
    left, top, right, bottom = edge(x, width), edge(y, height), edge(x + w, width), edge(y + h, height)
    fits = (right - left >= least) & (bottom - top >= least)
    return F.when(fits, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def transform_point(x: Column, y: Column, m: Column) -> Column:
    """A point under a 3x3 homography, given as an array of nine."""
    at = lambda k: F.get(m, F.lit(k))
    depth = at(6) * x + at(7) * y + at(8)
    return F.struct(((at(0) * x + at(1) * y + at(2)) / depth).alias("x"), ((at(3) * x + at(4) * y + at(5)) / depth).alias("y"))


def envelope(points: Column) -> Column:
    """The whole-pixel box around an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.floor(F.array_min(xs)).alias("left"), F.floor(F.array_min(ys)).alias("top"), F.ceil(F.array_max(xs)).alias("right"), F.ceil(F.array_max(ys)).alias("bottom"))


def transform_box(left: Column, top: Column, right: Column, bottom: Column, m: Column) -> Column:
    return envelope(F.array(*[transform_point(x, y, m) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]))


def learning_rate(step: Column, total: int, peak: float, warmup: int) -> Column:
    """Linear to the peak over `warmup` steps, then half a cosine to zero."""
    part = F.least((step - warmup) / F.lit(float(max(1, total - warmup))), F.lit(1.0))
    return F.when(step < warmup, peak * (step + 1) / float(max(1, warmup))).otherwise(peak * 0.5 * (1 + F.cos(math.pi * part)))


def severity_bucket(severity: Column) -> Column:
    return F.when(severity < 0.25, "0.00-0.25").when(severity < 0.5, "0.25-0.50").when(severity < 0.75, "0.50-0.75").otherwise("0.75-1.00")


def model_input(height: int, width: int, patch: tuple[int, int], characters: int = 44) -> dict[str, float]:
    """Rows and columns of patches, tokens, pixels and patches of a character, and width over height, of an input of so many pixels. Characters and patches must divide it."""
    if width % characters or height % patch[0] or width % patch[1]:
        raise ValueError(f"{characters} characters or patches of {patch} don't divide {height} x {width} pixels")
    rows, columns = height // patch[0], width // patch[1]
    return {"rows": rows, "columns": columns, "tokens": rows * columns, "px_per_char": width / characters, "patches_per_char": columns / characters, "aspect": width / height}
