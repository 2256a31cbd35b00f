"""Vector arithmetic on array columns, in the JVM and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(x: Column, digits: int = 6) -> Column:
    """x to `digits` places, halves away from zero, as SQL engines round doubles: what is rounded to zero keeps its sign, which F.round drops."""
    scale = F.lit(10.0**digits)

    def nearest(w: Column, y: Column) -> Column:
        whole = F.when(y - F.rint(y) == 0.5, F.rint(y) + 1).otherwise(F.rint(y))
        return F.when(y < float("inf"), F.signum(w) * whole / scale).otherwise(w)

    return let(x, lambda w: let(F.abs(w) * scale, lambda y: nearest(w, y)))


def l2_normalise(v: Column) -> Column:
    """v over its length; a zero vector has no direction and gives null components."""
    return let(v, lambda w: let(F.nullif(norm(w), F.lit(0.0)), lambda length: F.transform(w, lambda x: x / length)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a: Column, b: Column) -> Column:
    """Cosine with lengths of FLOOR at least, so that a zero vector gives 0."""
    return let(a, lambda x: let(b, lambda y: dot(x, y) / (F.greatest(norm(x), F.lit(FLOOR)) * F.greatest(norm(y), F.lit(FLOOR)))))


def direction_similarity(image0: Column, image1: Column, text0: Column, text1: Column) -> Column:
    return cosine(minus(image1, image0), minus(text1, text0))


def pair_metrics_clip(image0: Column, image1: Column, text0: Column, text1: Column) -> dict[str, Column]:
    """The four similarities of a candidate; all vectors are normalised first."""
    a, b, s, t = map(l2_normalise, (image0, image1, text0, text1))
    # lengths are one by then: only the directions differ from plain cosines
    return {"sim_0": cosine(image0, text0), "sim_1": cosine(image1, text1), "sim_dir": direction_similarity(a, b, s, t), "sim_image": cosine(image0, image1)}


def pair_metrics_dino(image0: Column, image1: Column) -> dict[str, Column]:
    """Images alone: the direction is compared with itself, which gives 1, or 0 for two equal images."""
    a, b = l2_normalise(image0), l2_normalise(image1)
    same = cosine(minus(b, a), minus(b, a))
    return {"sim_0": same, "sim_1": same, "sim_dir": same, "sim_image": cosine(a, b)}


def channel_normalise(pixels: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean_c) / std_c of interleaved channels."""
    n = len(mean)
    means, stds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std))
    return F.transform(pixels, lambda x, i: (x - F.get(means, i % n)) / F.get(stds, i % n))


def scale_255(pixels: Column) -> Column:
    """2 x / 255 - 1"""
    return F.transform(pixels, lambda x: x * 2.0 / 255.0 - 1.0)


def scale_127(pixels: Column) -> Column:
    """x / 127.5 - 1"""
    return F.transform(pixels, lambda x: x / 127.5 - 1.0)


def psnr(a: Column, b: Column) -> Column:
    """20 log10(255 / sqrt(MSE)); infinity for equal arrays, an error for unequal lengths."""
    fits = F.assert_true(F.size(a) == F.size(b), F.lit("arrays of different lengths"))
    d = minus(a, b)
    mean = let(d, lambda x: dot(x, x)) / F.size(a)
    value = let(mean, lambda mse: F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(255.0 / F.sqrt(F.nullif(mse, F.lit(0.0))))))
    return F.when(fits.isNull(), value)


def crop_border(pixels: Column, border: int) -> Column:
    """A 2-D array without `border` rows and columns at each side."""
    if not border:
        return pixels
    inner = F.slice(pixels, F.lit(border + 1), F.size(pixels) - 2 * border)
    return F.transform(inner, lambda row: F.slice(row, F.lit(border + 1), F.size(row) - 2 * border))
