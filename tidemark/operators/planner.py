"""Planning a set: greedy selection along an energy arc, its critique, and ordering of given tracks.

Each step depends on the one before, so a crate is planned in one grouped task of vectorised numpy: crates of different
listeners run in parallel. Crates are bounded (the tracks of one listener within the duration limits).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from ..functions.music import ENERGY_STEP, PHASES, TEMPO_SHIFT, TOLERANCE

#: Tracks that are ordered as one set, at least and at most, and what alike neighbours are worth.
LEAST_TRACKS, MOST_TRACKS = 2, 100
ALIKE = 0.25


@dataclass(frozen=True)
class Rules:
    """What a selection weighs and may not break. Fixed values."""

    minutes: float = 45.0
    floor: float = 0.3
    ceiling: float = 0.8
    familiar_ratio: float = 0.6
    per_artist: int = 2
    arc: float = 0.25
    coherence: float = 0.25
    taste: float = 0.2
    theme: float = 0.3
    transition: float = 0.15
    hard: bool = False
    widening: tuple[float, ...] = (1.0, 1.5, 2.0)


def arc_target(t: np.ndarray, floor: float, ceiling: float) -> np.ndarray:
    t = np.clip(t, 0, 1)
    i = np.minimum(np.searchsorted([p[2] for p in PHASES], t, "right"), len(PHASES) - 1)
    p = np.array([p[1:] for p in PHASES])[i]
    return floor + (p[:, 2] + (p[:, 3] - p[:, 2]) * (t - p[:, 0]) / (p[:, 1] - p[:, 0])) * (ceiling - floor)


def tempo_shifts(a, b) -> np.ndarray:
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    a, b = np.where(a == 0, np.nan, a), np.where(b == 0, np.nan, b)
    return np.min([np.abs(k * b - a) / a for k in (0.5, 1, 2)], axis=0)


def jars(shift: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (step > ENERGY_STEP) | (shift > 2 * TEMPO_SHIFT) | ((shift > TEMPO_SHIFT) & (step > ENERGY_STEP / 2))


def cost_of_move(shift: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.minimum(np.nan_to_num(shift / TEMPO_SHIFT, nan=0.5), 2) / 2 + np.minimum(step / ENERGY_STEP, 2) / 2


def positions(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ascending position from 0 to 1, ties by id."""
    if len(x) <= 1:
        return np.ones(len(x))
    out = np.empty(len(x))
    out[np.lexsort((ids, x))] = np.arange(len(x)) / (len(x) - 1)
    return out


def choose(crate: pd.DataFrame, rules: Rules, banned: frozenset = frozenset()) -> pd.DataFrame:
    """The chosen tracks with slot, start, target and what had to be relaxed. Ties go to the smallest track_id.

    crate: track_id, artist, energy, tempo, duration_ms, familiar, taste, theme_fit, sim (mean similarity to the seeds) and
    kc (active cells), sorted or not.
    """
    c = crate.sort_values("track_id").reset_index(drop=True)
    ids, energy, tempo = c["track_id"].to_numpy(), c["energy"].to_numpy(float), c["tempo"].to_numpy(float)
    seconds, familiar = c["duration_ms"].to_numpy(float) / 1000, c["familiar"].to_numpy(bool)
    artist = pd.factorize(c["artist"])[0]
    cells = [set(k) for k in c["kc"]]
    free, used = ~c["track_id"].isin(banned).to_numpy(), np.zeros(artist.max(initial=0) + 2, int)
    total, elapsed, last, out = rules.minutes * 60, 0.0, None, []
    while len(c) and total - elapsed > np.median(seconds) / 2:
        target = arc_target((elapsed + seconds / 2) / total, rules.floor, rules.ceiling)
        off, open_ = np.abs(energy - target), free & (used[artist] < rules.per_artist)
        wanted = familiar == (sum(familiar[i] for i in (r["i"] for r in out)) < rules.familiar_ratio * (len(out) + 1))
        sim, move, smooth = c["sim"].to_numpy(float), np.zeros(len(c)), np.ones(len(c), bool)
        if last is not None:
            near = np.array([2 * len(cells[last] & k) / max(1, len(cells[last]) + len(k)) for k in cells])
            sim = (near + sim) / 2 if sim.any() else near
            shift, step = tempo_shifts(tempo[last], tempo), np.abs(energy - energy[last])
            move = cost_of_move(shift, step)
            smooth = ~jars(shift, step) if rules.hard else smooth
        # rules are given up one after the other, the narrowest band first
        ways = [(open_ & (off <= TOLERANCE * w) & m, f"{name}{w:g}") for w in rules.widening for m, name in ((wanted & smooth, "band x"), (smooth, "ratio, band x"), (wanted, "transition, band x"), (np.ones(len(c), bool), "ratio and transition, band x"))]
        mask, note = next(((m, n) for m, n in ways if m.any()), (open_, "no band"))
        if not mask.any():
            break
        k = np.flatnonzero(mask)
        score = rules.arc * np.clip(1 - off[k] / TOLERANCE, 0, 1) + rules.coherence * positions(sim[k], ids[k]) + rules.taste * c["taste"].to_numpy(float)[k] + rules.theme * c["theme_fit"].to_numpy(float)[k] - rules.transition * move[k]
        best = k[int(np.argmax(np.round(score, 12)))]
        out.append({"i": best, "slot": len(out), "track_id": ids[best], "start_s": elapsed, "target": target[best], "energy": energy[best], "relaxed": note, "score": float(score.max())})
        free[best], last = False, best
        used[artist[best]] += 1
        elapsed += seconds[best]
    return pd.DataFrame(out, columns=["i", "slot", "track_id", "start_s", "target", "energy", "relaxed", "score"]).drop(columns="i")


_PICKS = "slot long, track_id long, start_s double, target double, energy double, relaxed string, score double"


def select(crate: DataFrame, listener: str, rules: Rules | None = None, banned: frozenset = frozenset()) -> DataFrame:
    """One set for each listener."""
    rules = rules or Rules()

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        return choose(f, rules, banned).assign(**{listener: key[0]})

    return crate.groupBy(listener).applyInPandas(run, f"{_PICKS}, {listener} {crate.schema[listener].dataType.simpleString()}")


def critique(picks: DataFrame, listener: str, minutes: float, least_lift: float = 0.1, length_tolerance: float = 0.15, per_artist: int = 2, asked: DataFrame | None = None) -> DataFrame:
    """Issues of each set: (listener, slot, kind). picks also has artist, tempo and duration_ms.

    Listeners of `asked` that have no picks get the one issue `empty`.
    """
    w, whole = Window.partitionBy(listener).orderBy("slot"), Window.partitionBy(listener)
    p = picks.withColumns({"shift": music.tempo_shift(F.lag("tempo").over(w), F.col("tempo")), "step": F.abs(F.col("energy") - F.lag("energy").over(w)), "nth": F.row_number().over(Window.partitionBy(listener, "artist").orderBy("slot")), "t": (F.col("start_s") + F.col("duration_ms") / 2000) / (minutes * 60), "n": F.count("*").over(whole)})
    slot = lambda cond, kind: p.where(cond).select(listener, "slot", F.lit(kind).alias("kind"))
    mean = lambda name: F.avg(F.when(music.phase("t") == name, F.col("energy")))
    shape = p.groupBy(listener).agg((mean("peak") - F.greatest(mean("opener"), mean("comedown"))).alias("lift"), (F.sum("duration_ms") / 1000 / (minutes * 60)).alias("length"))
    per_set = lambda cond, kind: shape.where(cond).select(listener, F.lit(0).cast("long").alias("slot"), F.lit(kind).alias("kind"))
    out = slot(F.abs(F.col("energy") - F.col("target")) > TOLERANCE, "off_arc").unionByName(slot(music.jarring("shift", "step"), "jarring")).unionByName(slot(F.col("nth") > per_artist, "artist_cap"))
    out = out.unionByName(per_set(F.col("lift") < least_lift, "flat_shape")).unionByName(per_set(F.abs(F.col("length") - 1) > length_tolerance, "length"))
    if asked is None:
        return out
    without = asked.select(listener).distinct().join(picks.select(listener), listener, "left_anti")
    return out.unionByName(without.select(listener, F.lit(0).cast("long").alias("slot"), F.lit("empty").alias("kind")))


def order_tracks(f: pd.DataFrame, floor: float | None = None, ceiling: float | None = None, window: int = 3, passes: int = 8) -> pd.DataFrame:
    """Given tracks along an arc fitted to them: sorted energies meet sorted targets, then near swaps while they help.

    Where the tracks have kc (active cells), alike neighbours lower an order's cost.
    """
    f = f.drop_duplicates("track_id").sort_values("track_id").reset_index(drop=True)
    n, e, tempo = len(f), f["energy"].to_numpy(float), f["tempo"].to_numpy(float)
    if n < 2:
        return f.assign(slot=np.arange(n))[["slot", "track_id"]]
    d = f["duration_ms"].to_numpy(float)
    shape = [x for p in PHASES for x in p[3:]]
    if floor is None:
        span = (e.max() - e.min()) / (max(shape) - min(shape))
        floor, ceiling = e.min() - min(shape) * span, e.min() + (1 - min(shape)) * span
    order = np.empty(n, int)
    order[np.argsort(arc_target((np.arange(n) + 0.5) / n, floor, ceiling), kind="stable")] = np.argsort(e, kind="stable")

    alike = np.zeros((n, n))
    if "kc" in f:
        cells = [set(k) for k in f["kc"]]
        alike = np.array([[2 * len(a & b) / max(1, len(a) + len(b)) for b in cells] for a in cells])

    def cost(o: np.ndarray) -> float:
        mid = (np.cumsum(d[o]) - d[o] / 2) / d.sum()
        shift, step = tempo_shifts(tempo[o[:-1]], tempo[o[1:]]), np.abs(np.diff(e[o]))
        return float(np.abs(e[o] - arc_target(mid, floor, ceiling)).sum() / TOLERANCE + 0.5 * cost_of_move(shift, step).sum() + 2 * jars(shift, step).sum() - ALIKE * alike[o[:-1], o[1:]].sum())

    best = cost(order)
    for _ in range(passes):
        before = best
        for i in range(n):
            for j in range(i + 1, min(i + window + 1, n)):
                order[[i, j]] = order[[j, i]]
                new = cost(order)
                if new < best - 1e-9:
                    best = new
                else:
                    order[[i, j]] = order[[j, i]]
        if best >= before:
            break
    return pd.DataFrame({"slot": np.arange(n), "track_id": f["track_id"].to_numpy()[order]})


def in_sets(tracks: DataFrame, by: str, most: int = MOST_TRACKS) -> DataFrame:
    """Adds set_no: each group's tracks, by track_id, in as few sets of at most `most` as hold them all, of even sizes."""
    own = Window.partitionBy(by)
    t = tracks.withColumn("_r", F.dense_rank().over(own.orderBy("track_id"))).withColumn("_n", F.max("_r").over(own))
    return t.withColumn("set_no", F.floor((F.col("_r") - 1) * F.ceil(F.col("_n") / most) / F.col("_n")).cast("long")).drop("_r", "_n")


def order(tracks: DataFrame, *by: str) -> DataFrame:
    """The tracks of each group in order; groups are sets, of MOST_TRACKS at most."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        return order_tracks(f).assign(**dict(zip(by, key)))

    keys = ", ".join(f"{c} {tracks.schema[c].dataType.simpleString()}" for c in by)
    return tracks.groupBy(*by).applyInPandas(run, f"slot long, track_id long, {keys}")


def order_requests(asked: DataFrame, crate: DataFrame, by: str) -> DataFrame:
    """Each request's tracks in order: (by, slot, track_id, placed, refused). asked: by, track_id and place.

    A track asked for twice counts once. Tracks that the crate lacks come last, in the order they were asked for, and aren't
    placed. Requests of fewer than LEAST_TRACKS or more than MOST_TRACKS tracks, or with fewer than LEAST_TRACKS in the crate,
    are one row that says why they are refused.
    """
    wanted = asked.groupBy(by, "track_id").agg(F.min("place").alias("place")).join(crate.withColumn("_held", F.lit(True)), "track_id", "left")
    size = wanted.groupBy(by).agg(F.count("*").alias("_n"), F.count("_held").alias("_m"))
    bad = F.when(~F.col("_n").between(LEAST_TRACKS, MOST_TRACKS), F.format_string(f"pass {LEAST_TRACKS} to {MOST_TRACKS} distinct tracks, not %d", "_n"))
    size = size.withColumn("refused", bad.when(F.col("_m") < LEAST_TRACKS, F.format_string("only %d of %d tracks are in the crate", "_m", "_n")))
    own = wanted.join(size.where("refused is null"), by)
    placed = order(own.where("_held").drop("_held", "place", "_n", "_m", "refused"), by).select(by, "slot", "track_id", F.lit(True).alias("placed"), F.lit(None).cast("string").alias("refused"))
    last = F.row_number().over(Window.partitionBy(by).orderBy("place", "track_id")) + F.col("_m") - 1
    rest = own.where("_held is null").select(by, last.alias("slot"), "track_id", F.lit(False).alias("placed"), "refused")
    no = size.where("refused is not null").select(by, F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("track_id"), F.lit(False).alias("placed"), "refused")
    return placed.unionByName(rest).unionByName(no)
