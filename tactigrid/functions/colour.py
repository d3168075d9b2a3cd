"""Colour maps as column expressions; values are expected in 0..1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(v: Column, low: Column, high: Column) -> Column:
    """Clamped to 0..1; a degenerate range is widened by 1."""
    top = F.when(high - low <= 0, low + 1).otherwise(high)
    return F.least(F.greatest((v - low) / (top - low), F.lit(0.0)), F.lit(1.0))


def _clip(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def grayscale(v: Column) -> tuple[Column, Column, Column]:
    return v, v, v


def cubehelix(v: Column, start: float = 0.5, rotations: float = -1.5, hue: float = 1.2, gamma: float = 1.0) -> tuple[Column, Column, Column]:
    """D. A. Green's scheme (arXiv 1108.5083)."""
    light = F.pow(v, F.lit(gamma))
    phi = 2 * math.pi * (start / 3 + rotations * v)
    amplitude = hue * light * (1 - light) / 2
    # Fixed values of the published scheme.
    parts = ((-0.14861, 1.78277), (-0.29227, -0.90649), (1.97294, 0.0))
    return tuple(_clip(light + amplitude * (c * F.cos(phi) + s * F.sin(phi))) for c, s in parts)


def table_map(v: Column, table: list[tuple[float, float, float]]) -> tuple[Column, Column, Column]:
    """Linear interpolation in a table of colours."""
    place = v * (len(table) - 1)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    share = place - F.floor(place)
    columns = [F.array(*(F.lit(float(row[k])) for row in table)) for k in range(3)]
    return tuple(F.get(c, low) * (1 - share) + F.get(c, high) * share for c in columns)


def polynomial(v: Column, coefficients: list[tuple[float, float, float]]) -> tuple[Column, Column, Column]:
    """A colour map given by a polynomial a channel, constant term first; clamped to 0..1."""
    out = []
    for k in range(3):
        value = F.lit(coefficients[-1][k])
        for row in reversed(coefficients[:-1]):
            value = value * v + row[k]
        out.append(_clip(value))
    return tuple(out)


# Published fits of degree 6 to the four perceptual maps, within 0.02 of their tables of 256 colours. The tables
# themselves can be given to `table_map`.
POLYNOMIALS = {
    "inferno": [
        (0.0002189403691192265, 0.001651004631001012, -0.01948089843709184),
        (0.1065134194856116, 0.5639564367884091, 3.932712388889277),
        (11.60249308247187, -3.972853965665698, -15.9423941062914),
        (-41.70399613139459, 17.43639888205313, 44.35414519872813),
        (77.162935699427, -33.40235894210092, -81.80730925738993),
        (-71.31942824499214, 32.62606426397723, 73.20951985803202),
        (25.13112622477341, -12.24266895238567, -23.07032500287172),
    ],
    "magma": [
        (-0.002136485053939582, -0.000749655052795221, -0.005386127855323933),
        (0.2516605407371642, 0.6775232436837668, 2.494026599312351),
        (8.353717279216625, -3.577719514958484, 0.3144679030132573),
        (-27.66873308576866, 14.26473078096533, -13.64921318813922),
        (52.17613981234068, -27.94360607168351, 12.94416944238394),
        (-50.76852536473588, 29.04658282127291, 4.23415299384598),
        (18.65570506591883, -11.48977351997711, -5.601961508734096),
    ],
    "plasma": [
        (0.05873234392399702, 0.02333670892565664, 0.5433401826748754),
        (2.176514634195958, 0.2383834171260182, 0.7539604599784036),
        (-2.689460476458034, -7.455851135738909, 3.110799939717086),
        (6.130348345893603, 42.3461881477227, -28.51885465332158),
        (-11.10743619062271, -82.66631109428045, 60.13984767418263),
        (10.02306557647065, 71.41361770095349, -54.07218655560067),
        (-3.658713842777788, -22.93153465461149, 18.19190778539828),
    ],
    "viridis": [
        (0.2777273272234177, 0.005407344544966578, 0.3340998053353061),
        (0.1050930431085774, 1.404613529898575, 1.384590162594685),
        (-0.3308618287255563, 0.214847559468213, 0.09509516302823659),
        (-4.634230498983486, -5.799100973351585, -19.33244095627987),
        (6.228269936347081, 14.17993336680509, 56.69055260068105),
        (4.776384997670288, -13.74514537774601, -65.35303263337234),
        (-5.435455855934631, 4.645852612178535, 26.3124352495832),
    ],
}


def add(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def scaled(a: tuple[Column, ...], s: Column) -> tuple[Column, ...]:
    return tuple(x * s for x in a)
