"""Limb darkening and geometry of a transit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q_to_u(q1: Column, q2: Column) -> tuple[Column, Column]:
    root = F.sqrt(q1)
    return 2 * root * q2, root * (1 - 2 * q2)


def u_to_q(u1: Column, u2: Column) -> tuple[Column, Column]:
    """Null where the sum of the coefficients is not positive."""
    total = F.when(u1 + u2 > 0, u1 + u2)
    return total * total, u1 / (2 * total)


def inclination_degrees(a_over_r: Column, impact: Column) -> Column:
    """Null where the impact parameter is not between 0 and the distance."""
    return F.when((a_over_r > 0) & (impact >= 0) & (impact <= a_over_r), F.degrees(F.acos(impact / a_over_r)))


def duration_informed_a(rp: Column, b: Column, duration: Column, period: Column) -> Column:
    """The distance in stellar radii that a transit of that length asks for, within bounds."""
    chord = F.sqrt(F.greatest((1 + rp) * (1 + rp) - b * b, F.lit(1e-4)))
    return F.greatest(F.least(chord / F.greatest(F.sin(F.pi() * duration / period), F.lit(1e-3)), F.lit(80.0)), 1 + rp + 1e-3)


#: What a parameter set may break; names of output values, fixed.
PHYSICAL = (
    "rp_must_be_positive", "a_over_rstar_must_exceed_1_plus_rp", "impact_parameter_outside_transiting_range", "inclination_invalid", "q1_outside_unit_interval", "q2_outside_unit_interval", "jitter_must_be_nonnegative",
)


def violations(rp: Column, a: Column, b: Column, q1: Column, q2: Column, jitter: Column) -> Column:
    """The constraints of a transit model that parameters break, as an array of names in the order of PHYSICAL; null and
    numbers that are not finite break those on them."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    edge = 1 + F.greatest(F.when(real(rp), rp).otherwise(0.0), F.lit(0.0))
    unit = lambda q: real(q) & q.between(0, 1)
    holds = [real(rp) & (rp > 0), real(a) & (a > edge), real(b) & (b >= 0) & (b < edge), ~(real(a) & real(b) & (a > 0) & (b > a)), unit(q1), unit(q2), real(jitter) & (jitter >= 0)]
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in zip(holds, PHYSICAL))))


def plain_name(name: Column) -> Column:
    """A target's name without case, spaces and hyphens, by which names are compared."""
    return F.regexp_replace(F.lower(name), "[ -]", "")


def run_id(text: Column) -> Column:
    """A name that may be part of a path: runs of other characters than letters, digits, _, . and - become one _; null
    where nothing is left."""
    clean = F.regexp_replace(F.trim(text), "[^A-Za-z0-9_.-]+", "_")
    return F.when(clean != "", clean)
