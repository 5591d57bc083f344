"""What surrounds a planned set: the brief, filling by length, assignment to an arc, notes, and the log of a run."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from . import ranks

#: Themes (name, moods, least and most energy, hours, bonus at weekends).
THEMES = (
    ("slow sunrise", ("chill", "nostalgic", "romantic"), 0.15, 0.6, (5, 6, 7, 8, 9), 0.0),
    ("focus drift", ("chill", "nostalgic", "somber"), 0.2, 0.55, (9, 10, 11, 12, 13, 14, 15, 16), 0.0),
    ("golden hour", ("euphoric", "playful", "romantic"), 0.3, 0.8, (15, 16, 17, 18, 19), 0.0),
    ("night drive", ("melancholic", "anxious", "somber", "nostalgic"), 0.3, 0.75, (20, 21, 22, 23, 0), 0.0),
    ("peak time", ("euphoric", "triumphant", "aggressive", "playful"), 0.4, 0.95, (20, 21, 22, 23, 0, 1), 0.6),
    ("after hours", ("chill", "melancholic", "somber"), 0.1, 0.5, (0, 1, 2, 3, 4), 0.0),
    ("adrenaline", ("aggressive", "triumphant", "euphoric"), 0.5, 1.0, (), 0.0),
)
#: Moods, and words that stand for them.
MOODS = ("euphoric", "triumphant", "aggressive", "playful", "romantic", "nostalgic", "chill", "melancholic", "anxious", "somber")
WORDS = {
    "sad": "melancholic", "rain": "melancholic", "rainy": "melancholic", "blue": "melancholic", "happy": "euphoric", "party": "euphoric", "hype": "euphoric", "dance": "euphoric",
    "angry": "aggressive", "gym": "aggressive", "workout": "aggressive", "hard": "aggressive", "calm": "chill", "relax": "chill", "relaxing": "chill", "study": "chill", "focus": "chill",
    "love": "romantic", "date": "romantic", "sexy": "romantic", "memories": "nostalgic", "throwback": "nostalgic", "retro": "nostalgic", "tense": "anxious", "dark": "somber", "moody": "melancholic",
    "win": "triumphant", "epic": "triumphant", "fun": "playful", "silly": "playful",
}
SEEDS = 5


def theme(hour: int) -> str:
    """The first theme whose hours hold this one."""
    return next(t[0] for t in THEMES if hour % 24 in t[4])


def mood_profile(recent: DataFrame, crate: DataFrame) -> DataFrame:
    """(mood, weight): shares of moods among recent plays (track_id) that the crate has; weights add up to 1."""
    moods = recent.select("track_id").join(crate.select("track_id", "mood_tags"), "track_id").select(F.explode(F.array_distinct("mood_tags")).alias("mood"))
    n = moods.groupBy("mood").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("mood", (F.col("n") / F.col("t")).alias("weight"))


def score_themes(profile: DataFrame, hours: DataFrame) -> DataFrame:
    """(hour, is_weekend, theme, score) for each row of `hours` and theme: 1 in its hours, its bonus at weekends, and the cosine
    of its moods with the profile (0 without one), rounded to 3 places."""
    spark = profile.sparkSession
    themes = spark.createDataFrame([(n, list(m), list(h), b) for n, m, _, _, h, b in THEMES], "theme string, moods array<string>, hours array<int>, bonus double")
    norm = F.broadcast(profile.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")))
    fit = themes.select("theme", F.explode("moods").alias("mood")).join(profile, "mood", "left").groupBy("theme").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("dot"))
    fit = themes.join(fit, "theme").crossJoin(norm).withColumn("fit", F.coalesce(F.try_divide("dot", F.sqrt(F.size("moods")) * F.col("norm")), F.lit(0.0)))
    own = hours.select("hour", "is_weekend").crossJoin(F.broadcast(fit))
    score = F.array_contains("hours", F.col("hour").cast("int")).cast("double") + F.when(F.col("is_weekend"), F.col("bonus")).otherwise(0.0) + F.col("fit")
    return own.select("hour", "is_weekend", "theme", F.round(score, 3).alias("score"))


def resolve(requested: Column, name: str = "theme") -> list[Column]:
    """Columns of the theme that a text asks for: its name, moods and energy range.

    A theme named in the text, or whose name holds a text of four and more characters; else one of the text's own made of its
    mood words, with the energy range of the theme that shares most of them. Nulls if there are none.
    """
    said = F.lower(F.trim(requested))
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, m)).alias("moods"), F.lit(lo).alias("floor"), F.lit(hi).alias("ceiling")) for n, m, lo, hi, _, _ in THEMES])
    named = F.get(F.filter(table, lambda t: F.contains(said, t["name"]) | ((F.length(said) >= 4) & F.contains(t["name"], said))), F.lit(0))
    words = F.transform(F.split(said, r"\s+"), lambda w: F.regexp_replace(w, "^[.,!?'\"]+|[.,!?'\"]+$", ""))
    known = F.create_map(*[F.lit(x) for k, v in {**WORDS, **{m: m for m in MOODS}}.items() for x in (k, v)])
    moods = F.array_distinct(F.array_compact(F.transform(words, lambda w: F.try_element_at(known, w))))
    shared = F.transform(table, lambda t: F.struct(F.size(F.array_intersect(t["moods"], moods)).alias("n"), t["floor"].alias("floor"), t["ceiling"].alias("ceiling")))
    most = F.array_max(F.transform(shared, lambda t: t["n"]))
    closest = F.get(F.filter(shared, lambda t: t["n"] == most), F.lit(0))
    own = F.when(F.size(moods) > 0, F.struct(F.trim(requested).alias("name"), moods.alias("moods"), closest["floor"].alias("floor"), closest["ceiling"].alias("ceiling")))
    got = F.coalesce(named, own)
    return [got["name"].alias(name), got["moods"].alias("moods"), got["floor"].alias("floor"), got["ceiling"].alias("ceiling")]


def pick_seeds(crate: DataFrame, recent: DataFrame, moods: tuple[str, ...], n: int = SEEDS, without: DataFrame | None = None) -> DataFrame:
    """track_id and place (from 1) of at most n tracks that share a mood: those of `recent` (track_id, ts) latest first, then the
    others by taste; equal ones by track_id. Tracks of `without` are never seeds."""
    own = crate.where(F.arrays_overlap("mood_tags", F.array(*map(F.lit, moods)))).select("track_id", "taste")
    own = own.join(without.select("track_id"), "track_id", "left_anti") if without is not None else own
    own = own.join(recent.groupBy("track_id").agg(F.max("ts").alias("ts")), "track_id", "left")
    order = [F.desc_nulls_last("ts"), F.when(F.col("ts").isNull(), F.col("taste")).desc_nulls_last(), F.col("track_id")]
    best = own.orderBy(*order).limit(n)
    return best.select("track_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # n rows


def build(crate: DataFrame, asked: DataFrame, hour: int, minutes: int) -> DataFrame:
    """One row: theme, length, the requested seeds that the crate has (each once, ascending, as text) and why."""
    wanted = asked.select("track_id").distinct()
    held = wanted.join(crate.select("track_id").withColumn("held", F.lit(1)), "track_id", "left").groupBy("track_id").agg(F.max("held").alias("held"))
    got = held.agg(F.array_sort(F.collect_list(F.when(F.col("held") == 1, F.col("track_id")))).alias("seeds"), F.count("*").alias("n"))
    name = theme(hour)
    why = F.format_string(f"{name} at {hour}:00; %d of %d requested seeds are in the crate", F.size("seeds"), F.col("n"))
    return got.select(F.lit(name).alias("theme"), F.lit(minutes).alias("minutes"), F.concat(F.lit("["), F.array_join("seeds", ", "), F.lit("]")).alias("seeds"), why.alias("rationale"))


def seeds_by_moods(crate: DataFrame, recent: DataFrame, moods: DataFrame, n: int = SEEDS) -> DataFrame:
    """(moods, seeds): for each list of moods the seeds that `pick_seeds` would pick, in order.

    The best n of a list are among the best n of each of its moods, so tracks are cut to n for each mood first.
    """
    own = crate.select("track_id", "taste", F.explode(F.array_distinct("mood_tags")).alias("mood")).join(recent.groupBy("track_id").agg(F.max("ts").alias("ts")), "track_id", "left")
    order = [F.desc_nulls_last("ts"), F.when(F.col("ts").isNull(), F.col("taste")).desc_nulls_last(), F.col("track_id")]
    best = ranks.top_per(own, n, ["mood"], order, "place").drop("place")
    held = moods.select("moods").distinct().select("moods", F.explode("moods").alias("mood")).join(best, "mood").drop("mood").distinct()
    picked = ranks.top_per(held, n, ["moods"], order, "place")
    return picked.groupBy("moods").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "track_id"))), lambda x: x["track_id"]).alias("seeds"))


def compose(requests: DataFrame, crate: DataFrame, recent: DataFrame, n: int = SEEDS) -> DataFrame:
    """The brief of each request (request_id, hour, is_weekend, requested, minutes): theme, energy range, seeds and rationale.

    A theme that is asked for is read from the text; without one it is the theme of the highest score for the hour, the day and
    the moods of recent plays (of equal scores the smaller name). A text that names no mood gets no theme. Only distinct texts,
    hours and lists of moods are looked at; `recent` has track_id and ts.
    """
    said = requests.where("requested is not null").select("requested").distinct().select("requested", *resolve(F.col("requested")))
    scores = score_themes(mood_profile(recent, crate), requests.select("hour", "is_weekend").distinct())
    first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "theme")))
    scored = scores.groupBy("hour", "is_weekend").agg(first.alias("by_score"))
    named = F.create_map(*[F.lit(x) if isinstance(x, str) else x for name, moods, lo, hi, _, _ in THEMES for x in (name, F.struct(F.lit(name).alias("theme"), F.array(*map(F.lit, moods)).alias("moods"), F.lit(lo).alias("floor"), F.lit(hi).alias("ceiling")))])
    top, second = F.get("by_score", F.lit(0)), F.get("by_score", F.lit(1))
    own = requests.join(said, "requested", "left").join(scored, ["hour", "is_weekend"], "left")
    asked, how = F.struct("theme", "moods", "floor", "ceiling"), F.col("requested").isNotNull()
    own = own.withColumn("got", F.when(how, asked).otherwise(F.element_at(named, top["theme"])))
    why = F.when(how & F.col("theme").isNull(), F.concat(F.lit("no mood in: "), F.col("requested"))).when(how, F.lit("asked for"))
    why = why.otherwise(F.format_string("scored %.3f at %d:00, ahead of %s (%.3f)", -top["s"], F.col("hour"), second["theme"], -second["s"]))
    own = own.select("request_id", "minutes", "got.*", why.alias("rationale"))
    picked = seeds_by_moods(crate, recent, own.where("moods is not null"), n)
    return own.join(F.broadcast(picked), "moods", "left").select("request_id", "theme", "floor", "ceiling", "minutes", F.coalesce("seeds", F.array().cast(picked.schema["seeds"].dataType)).alias("seeds"), "rationale")


def fill(tracks: DataFrame, by: str, order: str, minutes: float) -> DataFrame:
    """Tracks of each group in order while more than half a median track's time is left."""
    w = Window.partitionBy(by)
    before = F.sum("duration_ms").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("duration_ms")
    mid = F.percentile("duration_ms", 0.5).over(w)
    return tracks.withColumns({"_b": before, "_m": mid}).where(minutes * 60_000 - F.col("_b") > F.col("_m") / 2).drop("_b", "_m")


def sorted_to_arc(tracks: DataFrame, by: str, floor: float, ceiling: float) -> DataFrame:
    """The k-th lowest energy of a group gets the slot with its k-th lowest target; ties by track_id and slot."""
    group = Window.partitionBy(by)
    own = tracks.select(by, "track_id", F.row_number().over(group.orderBy("energy", "track_id")).alias("k"), F.count("*").over(group).alias("n"))
    goal = own.select(by, (F.col("k") - 1).alias("slot"), F.round(music.target((F.col("k") - 0.5) / F.col("n"), floor, ceiling), 9).alias("target"))
    goal = goal.withColumn("k", F.row_number().over(group.orderBy("target", "slot")))
    return goal.join(own.drop("n"), [by, "k"]).select(by, "slot", "track_id", "target")


def notes(picks: DataFrame, issues: DataFrame, by: str, title: str) -> DataFrame:
    """A title and line for each track of a set; `ready` only where the critique found nothing. Nothing is sent anywhere."""
    line = F.format_string("%d. %s (%s)", F.col("slot") + 1, F.col("name"), F.col("artist"))
    text = picks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("slot", line.alias("line")))).alias("rows"), F.sum("duration_ms").alias("ms"))
    bad = issues.groupBy(by).agg(F.count("*").alias("issues"))
    got = text.join(bad, by, "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    head = F.format_string(f"{title}, %d tracks, %d min", F.size("rows"), F.round(F.col("ms") / 60_000).cast("int"))
    return got.select(by, head.alias("title"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("notes"), "issues", (F.col("issues") == 0).alias("ready"))


def run_log(picks: DataFrame, issues: DataFrame, by: str, rules) -> DataFrame:
    """All stages of each set's run as one JSON text: rules, picks in order, issues in order."""
    chosen = picks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("slot", "track_id", "target", "energy", "relaxed"))).alias("select"))
    found = issues.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("slot", "kind"))).alias("critique"))
    log = F.to_json(F.struct("select", F.coalesce("critique", F.array()).alias("critique")))
    rule = json.dumps(asdict(rules), sort_keys=True)
    return chosen.join(found, by, "left").select(by, F.concat(F.lit('{"rules":' + rule + ","), F.substr(log, F.lit(2))).alias("log"))
