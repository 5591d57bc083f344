"""The listening report: cards compiled from small aggregates, and their renderings."""

from __future__ import annotations

import hashlib
import html
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation, listening, ranks, warehouse

SCHEMA_VERSION = "2.1"
#: Rule, metric, whether it must be at least the threshold, threshold.
ARCHETYPES = (("explorer", "discovery_ratio", True, 0.4), ("loyalist", "top1_share", True, 0.25), ("time_traveller", "old_share", True, 0.5), ("specialist", "cluster_evenness", False, 0.7), ("restless", "skip_rate", True, 0.25))


@dataclass(frozen=True)
class Profile:
    """Whose history a report is made of. Each has folders of its own, and only reports of made-up ones may be published."""

    name: str
    private: bool

    def warehouse(self, root: str) -> str:
        return f"{root}/{self.name}/warehouse" if root else f"{self.name}/warehouse"

    def may_publish(self) -> bool:
        return not self.private


PROFILES = (Profile("private", True), Profile("synthetic", False))


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]


#: A release is old if it is so many years before the window's last play; hidden gems have at most so many plays.
OLD_YEARS, GEM_PLAYS = 20, 2


def archetype_metrics(plays: DataFrame, start: str | None = None, end: str | None = None, zone: str = "UTC", years: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """What the rules test, over the plays of a window. First listens are judged on the whole history, then the window is cut.

    `years` (track_id, year) gives old_share, `clusters` (track_id, cluster) cluster_evenness; without them both are null, and
    their rules can't fire.
    """
    first = F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id")) == 1
    own = warehouse.in_window(plays.withColumn("first", first), start, end, zone)
    base = own.agg(F.avg(F.col("first").cast("int")).alias("discovery_ratio"), F.avg((F.col("verdict") < 0).cast("int")).alias("skip_rate"))
    counts = own.groupBy("track_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    totals = F.broadcast(counts.agg(F.greatest(F.lit(1), F.floor(F.sum("k") / 100)).alias("m"), F.sum(F.col("n") * F.col("k")).alias("t")))
    before = F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
    taken = F.greatest(F.lit(0), F.least(F.col("k"), F.col("m") - F.col("before")))
    top = counts.withColumn("before", before).crossJoin(totals).agg((F.sum(taken * F.col("n")) / F.max("t")).alias("top1_share"))
    got = base.crossJoin(top)
    if years is not None:
        last = F.broadcast(own.agg(F.year(F.max("ts")).alias("last")))
        dated = own.groupBy("track_id").agg(F.count("*").alias("n")).join(years.where("year is not null"), "track_id").crossJoin(last)
        old = F.sum(F.when(F.col("year") < F.col("last") - OLD_YEARS, F.col("n")).otherwise(0))
        got = got.crossJoin(dated.agg(F.try_divide(old.cast("double"), F.sum("n")).alias("old_share")))
    else:
        got = got.withColumn("old_share", F.lit(None).cast("double"))
    if clusters is not None:
        shares = own.join(clusters, "track_id").groupBy("cluster").agg(F.count("*").alias("n"))
        return got.crossJoin(evaluation.shannon_evenness(shares, "n").select(F.col("evenness").alias("cluster_evenness")))
    return got.withColumn("cluster_evenness", F.lit(None).cast("double"))


def archetype(metrics: dict) -> str:
    """The rule that is passed by the widest margin, the larger name of equal ones; none: all_rounder."""
    passed = []
    for rule, metric, least, threshold in ARCHETYPES:
        v = metrics.get(metric)
        if v is not None and (v >= threshold if least else 0 < v <= threshold):
            passed.append((v / threshold if least else threshold / v, rule))
    return max(passed)[1] if passed else "all_rounder"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _year_cards(tracks: DataFrame, years: DataFrame, last: int) -> list[dict]:
    """listening_age (median year of release, weighted by plays, and the oldest album) and decade_histogram, with coverage."""
    own = tracks.join(years, "track_id", "left").select("track_id", "artist", "album", "play_count", "year")
    dated = own.where("year is not null")
    used = _rows(own.agg(F.count("year").alias("tracks_used"), F.count("*").alias("tracks_of"), F.sum(F.when(F.col("year").isNotNull(), F.col("play_count"))).alias("plays_used"), F.sum("play_count").alias("plays_of")))[0]
    if not used["tracks_used"]:
        return []
    middle = _rows(dated.agg(F.percentile("year", 0.5, F.col("play_count")).cast("int").alias("year")))[0]["year"]
    oldest = _rows(ranks.top(dated, 1, "year", F.desc("play_count"), "track_id").select("artist", "album", "year"))[0]
    decades = dated.groupBy((F.floor(F.col("year") / 10) * 10).alias("decade")).agg(F.sum("play_count").alias("plays")).orderBy("decade")
    note = coverage_note({"tier": "B", **used})
    histogram = [{**r, "share": r["plays"] / used["plays_used"]} for r in _rows(decades)]
    peak = max(histogram, key=lambda r: (r["plays"], -r["decade"]))
    return [{"id": "listening_age", "age": last - middle, "year": middle, "oldest": oldest, "coverage": note, **used}, {"id": "decade_histogram", "rows": histogram, "coverage": note, "evidence": [f"{peak['decade']}s: {peak['share']:.0%} of plays"]}]


def _cluster_card(own: DataFrame, clusters: DataFrame) -> list[dict]:
    """taste_clusters: plays, share, tracks and the three most played artists of each."""
    c = own.join(clusters, "track_id")
    per = c.groupBy("cluster").agg(F.count("*").alias("plays"), F.count_distinct("track_id").alias("tracks"))
    names = ranks.top_per(c.groupBy("cluster", "artist_name").agg(F.count("*").alias("n")), 3, ["cluster"], [F.desc("n"), "artist_name"], "place")
    names = names.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "artist_name"))), lambda x: x["artist_name"]).alias("artists"))
    rows = sorted(_rows(per.join(names, "cluster")), key=lambda r: (-r["plays"], r["cluster"]))
    total = sum(r["plays"] for r in rows)
    return [{"id": "taste_clusters", "rows": [{**r, "share": r["plays"] / total} for r in rows], "evidence": [f"{', '.join(r['artists'])} ({r['plays'] / total:.0%})" for r in rows[:3]]}] if rows else []


def _gem_card(tracks: DataFrame, valence: DataFrame, top_n: int) -> list[dict]:
    """hidden_gems: few plays, never skipped, the highest valence; one for each artist."""
    g = tracks.where(F.col("play_count").between(1, GEM_PLAYS) & (F.col("skip_rate") == 0)).join(valence, "track_id").select("track_id", "name", "artist", "play_count", "valence")
    rows = _rows(ranks.top(ranks.keep_one(g, ["artist"], [F.desc("valence"), "track_id"]), top_n, F.desc("valence"), "track_id"))
    return [{"id": "hidden_gems", "rows": rows, "evidence": [f'"{r["name"]}" by {r["artist"]}' for r in rows[:3]]}] if rows else []


def build(plays: DataFrame, start: str | None = None, end: str | None = None, zone: str = "UTC", top_n: int = 5, years: DataFrame | None = None, clusters: DataFrame | None = None, valence: DataFrame | None = None) -> dict:
    """The report of one window. Every collect is of a bounded aggregate; cards without data are left out.

    `years` (track_id, year), `clusters` (track_id, cluster) and `valence` (track_id, valence) give the cards that need them.
    """
    own = warehouse.in_window(plays, start, end, zone)
    total = _rows(listening.summary(own))[0]
    tracks = warehouse.tracks(own)
    cards = []
    if total["total_hours"]:
        cards.append({"id": "total_hours", "hours": round(total["total_hours"], 3), "plays": total["total_plays"], "tracks": total["unique_tracks"], "artists": total["unique_artists"]})
    months = warehouse.artist_months(own.withColumn("ts", warehouse.local("ts", zone)))
    # racers are bounded by months and top_n; the card keeps those who lead at the end
    sprint = ranks.keep_one(listening.artist_sprint(months, top_n), ["artist"], [F.desc("month")]).select("artist", F.col("cumulative_plays").alias("plays"))
    tables = {"top_artists": listening.top_artists(own, limit=top_n), "top_tracks": listening.top_tracks(tracks, top_n), "top_albums": listening.top_albums(tracks, top_n), "artist_sprint": ranks.top(sprint, top_n, F.desc("plays"), "artist")}
    for name, df in tables.items():
        if rows := _rows(df):
            cards.append({"id": name, "rows": rows})
    cards.append({"id": "time_of_day", "hours": [r["play_count"] for r in sorted(_rows(listening.time_of_day(own, zone)), key=lambda r: r["hour"])]})
    if rows := _rows(ranks.top(listening.skip_offenders(tracks), top_n, F.desc("skip_rate"), F.desc("play_count"), "track_id")):
        cards.append({"id": "skip_offenders", "rows": rows})
    if years is not None and total["latest_play"]:
        cards += _year_cards(tracks, years, total["latest_play"].year)
    cards += _cluster_card(own, clusters) if clusters is not None else []
    cards += _gem_card(tracks, valence, top_n) if valence is not None else []
    metrics = _rows(archetype_metrics(plays, start, end, zone, years, clusters))[0]
    cards.append({"id": "archetype", "label": archetype(metrics), "metrics": metrics})
    config = {"top_n": top_n, "zone": zone, "start": start, "end": end}
    return {"schema_version": SCHEMA_VERSION, "window": {"start": start, "end": end}, "config": config_hash(config), "cards": cards}


def check_version(report: dict) -> None:
    if str(report.get("schema_version", "")).split(".")[0] != SCHEMA_VERSION.split(".")[0]:
        raise ValueError(f"report version {report.get('schema_version')} is not {SCHEMA_VERSION}")


def readable(version: Column) -> Column:
    """Whether `check_version` lets a version pass."""
    return F.coalesce(F.split_part(version, F.lit("."), F.lit(1)) == SCHEMA_VERSION.split(".")[0], F.lit(False))


def cell(x) -> str:
    if x is None:
        return ""
    if isinstance(x, float):
        return f"{x:,.3f}".rstrip("0").rstrip(".")
    return f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)[:60]


def markdown_table(df: DataFrame, most: int = 40) -> str:
    """At most `most` rows; how many more there are is said."""
    rows = df.limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)] + ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"… {df.count() - most} more rows"] if len(rows) > most else []))


def coverage_note(coverage: dict) -> str:
    """What a card rests on: the share of plays, else of measured tracks, else the number of tracks."""
    c, tier = coverage, f"Tier {coverage['tier']}"
    if c.get("plays_of"):
        return f"{tier} · covers {c['plays_used'] / c['plays_of']:.0%} of plays"
    if "measured" in c and c["tracks_used"]:
        return f"{tier} · all {c['tracks_used']:,} tracks · {c['measured'] / c['tracks_used']:.0%} with measured audio, the rest predicted features only"
    return f"{tier} · {c['tracks_used']:,} of {c['of']:,} tracks"


def markdown(report: dict) -> str:
    out = ["# Listening report"]
    for c in report["cards"]:
        out += [f"\n## {c['id'].replace('_', ' ')}"] + [f"- {k}: {cell(v) if not isinstance(v, (list, dict)) else json.dumps(v, default=str)}" for k, v in c.items() if k != "id"]
    return "\n".join(out)


def to_html(report: dict) -> str:
    return "<article>" + "".join(f"<p>{html.escape(line)}</p>" for line in markdown(report).splitlines() if line) + "</article>"


def export(reports: dict[str, dict], folder: str) -> None:
    """One JSON file for each window, and an index."""
    import os

    os.makedirs(folder, exist_ok=True)
    for name, r in reports.items():
        with open(os.path.join(folder, f"{name}.json"), "w") as f:
            json.dump(r, f, default=str)
    with open(os.path.join(folder, "index.json"), "w") as f:
        json.dump([{"window": n, "config": r["config"]} for n, r in sorted(reports.items())], f)


#: Read-only tools: name to (needs tracks, function). Errors become text.
TOOLS = {"top_artists": (False, listening.top_artists), "top_tracks": (True, listening.top_tracks), "top_albums": (True, listening.top_albums), "summary": (False, listening.summary), "listening_clock": (False, listening.clock), "skip_offenders": (True, listening.skip_offenders), "rediscovery_candidates": (True, listening.rediscovery), "search_library": (True, listening.search), "taste_drift": (False, listening.taste_drift)}


def call(tool: str, plays: DataFrame, **arguments) -> str:
    try:
        needs_tracks, f = TOOLS[tool]
        return markdown_table(f(warehouse.tracks(plays) if needs_tracks else plays, **arguments))
    except Exception as e:  # a tool's caller gets text whatever happens
        return f"{tool} failed: {type(e).__name__}: {e}"
