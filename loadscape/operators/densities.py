"""Toy densities for trying out generators: points from column expressions, any number of them, the same at every run."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the public toy densities: centres of the Gaussian mixtures and the spread around them.
_DIAGONAL = 4 / math.sqrt(2)
EIGHT = ((4.0, 0.0), (-4.0, 0.0), (0.0, 4.0), (0.0, -4.0), (_DIAGONAL, _DIAGONAL), (_DIAGONAL, -_DIAGONAL), (-_DIAGONAL, _DIAGONAL), (-_DIAGONAL, -_DIAGONAL))
FOUR = ((2.0, -2.0), (-2.0, 2.0), (2.0, 2.0), (-2.0, -2.0))
TWO, TWO_LEVEL = FOUR[:2], ((2.0, 0.0), (-2.0, 0.0))


class Noise:
    """Numbers decided by a seed, the point's id and a place: uniform in [0, 1), and standard normal (from two places)."""

    def __init__(self, seed: str, i: Column):
        self.seed, self.i = seed, i

    def uniform(self, place: int) -> Column:
        digest = F.md5(F.concat(F.lit(f"{self.seed}:"), self.i.cast("string"), F.lit(f":{place}")).cast("binary"))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))

    def normal(self, place: int) -> Column:
        return F.sqrt(-2 * F.ln(1 - self.uniform(place))) * F.cos(2 * math.pi * self.uniform(place + 1))


def _mixture(centres, spread: float, scale: float = 1.0) -> Callable[[Noise], list[Column]]:
    def make(z: Noise) -> list[Column]:
        which = F.floor(z.uniform(0) * len(centres)).cast("int") + 1
        at = [F.element_at(F.array(*[F.lit(c[k]) for c in centres]), which) for k in (0, 1)]
        return [(at[k] + spread * z.normal(1 + 2 * k)) / scale for k in (0, 1)]

    return make


def _ring(z: Noise, radii: tuple[float, ...], spread: float, scale: float) -> list[Column]:
    radius = F.element_at(F.array(*map(F.lit, radii)), F.floor(z.uniform(0) * len(radii)).cast("int") + 1)
    turn = 2 * math.pi * z.uniform(1)
    return [(radius * f(turn) + spread * z.normal(2 + 2 * k)) * scale for k, f in enumerate((F.cos, F.sin))]


def _spirals(z: Noise) -> list[Column]:
    n, side = F.sqrt(z.uniform(0)) * 3 * math.pi, F.when(z.uniform(1) < 0.5, 1.0).otherwise(-1.0)
    x, y = -F.cos(n) * n + z.uniform(2) * 0.5, F.sin(n) * n + z.uniform(3) * 0.5
    return [side * x / 3 + 0.1 * z.normal(4), side * y / 3 + 0.1 * z.normal(6)]


def _pinwheel(z: Noise) -> list[Column]:
    along, across = 1 + 0.3 * z.normal(0), 0.1 * z.normal(2)
    angle = 2 * math.pi / 5 * F.floor(z.uniform(4) * 5) + 0.25 * F.exp(along)
    return [2 * (along * F.cos(angle) + across * F.sin(angle)), 2 * (across * F.cos(angle) - along * F.sin(angle))]


def _moons(z: Noise) -> list[Column]:
    turn, upper = math.pi * z.uniform(0), z.uniform(1) < 0.5
    x, y = F.when(upper, F.cos(turn)).otherwise(1 - F.cos(turn)), F.when(upper, F.sin(turn)).otherwise(0.5 - F.sin(turn))
    return [2 * (x + 0.1 * z.normal(2)) - 1, 2 * (y + 0.1 * z.normal(4)) - 0.2]


def _roll(z: Noise) -> list[Column]:
    t = 1.5 * math.pi * (1 + 2 * z.uniform(0))
    return [(t * F.cos(t) + z.normal(1)) / 5, (t * F.sin(t) + z.normal(3)) / 5]


def _board(z: Noise) -> list[Column]:
    x = z.uniform(0) * 4 - 2
    return [2 * x, 2 * (z.uniform(1) - 2 * F.floor(2 * z.uniform(2)) + F.pmod(F.floor(x), F.lit(2)))]


def _line(spread: float) -> Callable[[Noise], list[Column]]:
    return lambda z: [z.uniform(0) * 5 - 2.5, z.uniform(0) * 5 - 2.5 + spread * z.normal(1)]


def _wave(z: Noise) -> list[Column]:
    x = z.uniform(0) * 6 - 3
    return [x, F.sin(x * 5) * 2.5 + 0.3 * z.normal(1)]


def _parabola(z: Noise) -> list[Column]:
    y = 4 * z.normal(0)
    return [z.normal(2) + y * y / 4, y]


DENSITIES: dict[str, Callable[[Noise], list[Column]]] = {
    "1normal": lambda z: [2 + 0.5 * z.normal(0)],
    "8gaussians": _mixture(EIGHT, 0.5, 1.414),
    "4gaussians": _mixture(FOUR, 0.75),
    "2gaussians": _mixture(TWO, 0.75),
    "2igaussians": _mixture(TWO_LEVEL, 0.75),
    "2spirals": _spirals,
    "circles": lambda z: _ring(z, (1.0, 0.5), 0.08, 3.0),
    "rings": lambda z: _ring(z, (1.0, 0.75, 0.5, 0.25), 0.08 / 3, 3.0),
    "moons": _moons,
    "pinwheel": _pinwheel,
    "swissroll": _roll,
    "checkerboard": _board,
    "line": _line(0.0),
    "line-noisy": _line(1.0),
    "cos": _wave,
    "joint_gaussian": _parabola,
}
#: Densities side by side, each part with numbers of its own.
JOINT = {"2spirals-8gaussians": ("2spirals", "8gaussians"), "4-2spirals-8gaussians": ("2spirals", "8gaussians") * 2, "8-2spirals-8gaussians": ("2spirals", "8gaussians") * 4}


def points(spark: SparkSession, name: str, n: int, seed: str = "toy") -> DataFrame:
    """(i, point): n points of a density, each an array of its one to sixteen coordinates."""
    i = F.col("id")
    parts = [c for k, part in enumerate(JOINT.get(name, (name,))) for c in DENSITIES[part](Noise(f"{seed}:{k}", i))]
    return spark.range(n).select(i.alias("i"), F.array(*parts).alias("point"))
