"""Cards of all windows: each equals the card of that window's plays alone; rows without a date, album or cluster."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cards, warehouse

SCHEMA = "ts timestamp_ntz, track_id string, track_name string, artist_name string, album_name string, ms_played long, reason_end string"
T = datetime.datetime


@pytest.fixture(scope="module")
def plays(spark):
    rows = [(T(2023, 12, 31, 23, 30), "t1", "One", "A", "X (Remastered)", 60000, "fwdbtn"), (T(2024, 1, 1, 3), "t1", "One", "A", "X (Remastered)", 60000, "trackdone"), (T(2024, 1, 1, 6), "t2", "Two", "A", "X", 120000, "trackdone")]
    rows += [(T(2024, 5, d), "t3", "Three", "B", "Y", 30000, "fwdbtn") for d in range(1, 8)] + [(T(2025, 2, 1, h), f"u{h}", f"U{h}", "C", None, 1000, "trackdone") for h in range(5)]
    rows += [(None, "t1", "One", "A", "X (Remastered)", 5, "other"), (T(2024, 2, 2), None, None, None, None, 7, "other"), (T(2024, 3, 3), "t9", "Nine", None, "", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def releases(spark):
    return spark.createDataFrame([("a|x", 1971), ("b|y", 1999), ("b|y", 2003), ("c|z", None)], "album_key string, release_year long")


def test_windows_equal_cards_of_their_plays_alone(spark, plays):
    zone = "America/New_York"
    tracks = cards.window_tracks(plays, zone)
    assert {r.window_id: r.plays for r in cards.totals(tracks).collect()} == {"all": 17, "2023": 2, "2024": 9, "2025": 5}
    for year in (2023, 2024, 2025):
        alone = cards.window_tracks(warehouse.in_window(plays, f"{year}-01-01", f"{year + 1}-01-01", zone), zone)
        for card in (lambda t: cards.tops(t), lambda t: cards.listening_age(t, releases(spark)), lambda t: cards.decades(t, releases(spark)), cards.totals, cards.skip_offenders):
            one = {tuple(r)[1:] for r in card(alone).where("window_id = 'all'").select("window_id", *sorted(set(card(alone).columns) - {"window_id"})).collect()}
            assert {tuple(r)[1:] for r in card(tracks).where(F.col("window_id") == str(year)).select("window_id", *sorted(set(card(tracks).columns) - {"window_id"})).collect()} == one


def test_albums_ages_and_decades(spark, plays):
    tracks = cards.window_tracks(plays, "UTC")
    tops = {(r.window_id, r.card, r.place): (r.label, r.plays, r.evidence) for r in cards.tops(tracks).collect()}
    # both editions of X count together, under the name of the smallest track_id
    assert tops["all", "top_albums", 2] == ("A - X (Remastered)", 4, "A - X (Remastered) (4 plays)")
    assert tops["2024", "top_artists", 1][:2] == ("B", 7) and ("2024", "top_artists", 3) not in tops
    age = {r.window_id: r for r in cards.listening_age(tracks, releases(spark)).collect()}
    assert set(age) == {"all", "2023", "2024"}  # nothing of 2025 is dated
    assert age["all"].year == 1999 and age["all"].oldest == 'oldest: A, "X (Remastered)" (1971)' and age["all"].coverage == "Tier B · covers 65% of plays"
    assert age["all"].old_share == 1.0 and age["2024"].old_share == 1.0
    shares = {(r.window_id, r.decade): (r.plays, r.place, r.evidence) for r in cards.decades(tracks, releases(spark)).collect()}
    assert shares["all", 1990] == (7, 1, "1990s: 64% (7 plays)") and shares["2023", 1970] == (1, 1, "1970s: 100% (1 plays)")


def test_clusters_hours_and_the_whole_report(spark, plays):
    clusters = spark.createDataFrame([("t1", 0, True), ("t2", 0, False), ("t3", 1, True), ("never", 2, True)], "track_id string, cluster long, measured boolean")
    names = spark.createDataFrame([(0, "Calm"), (1, "Loud"), (2, "None")], "cluster long, name string")
    tracks = cards.window_tracks(plays, "UTC")
    got = {(r.window_id, r.place): r for r in cards.taste_clusters(tracks, clusters, names).collect()}
    assert got["all", 1].evidence == "Loud: 64% of plays (B)" and got["all", 2].artists == "A" and got["all", 1].coverage == "Tier A · all 3 tracks · 67% with measured audio, the rest predicted features only"
    hours = {(r.window_id, r.hour): r.plays for r in cards.time_of_day(plays, "America/New_York").collect()}
    assert len(hours) == 4 * 24 and hours["2023", 22] == 1 and hours["all", 22] == 2 and hours["2024", 1] == 1 and hours["2025", 12] == 0
    whole = cards.report(plays, "UTC", releases(spark), clusters, names)
    assert {r.card for r in whole.where("window_id = 'all'").select("card").distinct().collect()} == set(cards.ORDER)
    assert {r.card for r in whole.where("window_id = '2025'").select("card").distinct().collect()} == {"total_hours", "top_artists", "top_tracks", "time_of_day"}
    assert cards.report(plays.where("ms_played < 0"), "UTC", releases(spark), clusters, names).collect() == []
