"""Arithmetic of the planner: tempo, energy arcs and transitions, of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phases of a set (name, start, end, shape at start, shape at end), and limits of transitions.
PHASES = (("opener", 0.0, 0.15, 0.2, 0.2), ("build", 0.15, 0.55, 0.2, 0.9), ("peak", 0.55, 0.8, 0.95, 0.95), ("comedown", 0.8, 1.0, 0.95, 0.25))
TOLERANCE = 0.15
TEMPO_SHIFT, ENERGY_STEP = 0.12, 0.25
MIN_BPM, MIN_MS, MAX_MS, DEFAULT_MS = 40.0, 60_000, 600_000, 210_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tempo_shift(a, b) -> Column:
    """Relative change of tempo, half and double time counting as the same; null where either is missing, zero or NaN."""
    valid = lambda x: F.when(F.isnan(x) | (x == 0), None).otherwise(x)
    a, b = valid(_c(a).cast("double")), valid(_c(b).cast("double"))
    return F.when(a.isNotNull() & b.isNotNull(), F.least(*[F.abs(b * k - a) / a for k in (0.5, 1.0, 2.0)]))


def jarring(shift, step) -> Column:
    """Whether a transition is rejected, by its tempo shift (null: unknown) and energy step."""
    shift, step = _c(shift), _c(step)
    return (step > ENERGY_STEP) | F.coalesce(shift > 2 * TEMPO_SHIFT, F.lit(False)) | F.coalesce((shift > TEMPO_SHIFT) & (step > ENERGY_STEP / 2), F.lit(False))


def transition_cost(shift, step) -> Column:
    shift, step = _c(shift), _c(step)
    return F.least(F.coalesce(shift / TEMPO_SHIFT, F.lit(0.5)), F.lit(2.0)) / 2 + F.least(step / ENERGY_STEP, F.lit(2.0)) / 2


def phase(t) -> Column:
    t = _c(t)
    out = F.lit(PHASES[-1][0])
    for name, _, end, _, _ in reversed(PHASES):
        out = F.when(t < end, name).otherwise(out)
    return out


def target(t, floor: float, ceiling: float) -> Column:
    """Energy asked for at a share of the set; a boundary belongs to the phase after it."""
    t = F.least(F.greatest(_c(t), F.lit(0.0)), F.lit(1.0))
    at = lambda p: p[3] + (p[4] - p[3]) * (t - p[1]) / (p[2] - p[1])
    out = at(PHASES[-1])
    for p in reversed(PHASES[:-1]):
        out = F.when(t < p[2], at(p)).otherwise(out)
    return floor + out * (ceiling - floor)


def valid_tempo(x) -> Column:
    return F.when(_c(x) >= MIN_BPM, _c(x))


def duration(ms) -> Column:
    return F.when(_c(ms) >= MIN_MS, _c(ms)).otherwise(F.lit(DEFAULT_MS))


def dice(hamming, a, b) -> Column:
    """Similarity from a Hamming distance and the numbers of bits; 0 if both are empty."""
    total = _c(a) + _c(b)
    return F.when(total > 0, 1 - _c(hamming) / total).otherwise(0.0)
