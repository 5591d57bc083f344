"""Reports as files: what is written is read back, versions are looked at, odd labels are escaped."""

import glob
import json

import pytest

from tidemark.sources import reports

ROWS = [("all", 1, "total_hours", 1, "3 plays", 0.5), ("all", 2, "top_tracks", 2, 'a "b" | <c> & d', 1234.5), ("all", 2, "top_tracks", 1, None, None), ("2023", 1, "total_hours", None, "x", 2.0)]
SCHEMA = "window_id string, card_no long, card string, place long, label string, value double"


def test_reports_round_trip(spark, tmp_path):
    rows, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "r")
    reports.write(rows, path)
    back = lambda *w: sorted(map(tuple, reports.card_rows(reports.read(spark, path, *w)).select(*rows.columns).collect()), key=str)
    assert back() == sorted(ROWS, key=str) and back("2023") == [ROWS[3]] and back("1999") == []
    assert sorted(map(tuple, reports.index(spark, path).collect())) == [("2023", 1, 1), ("all", 2, 3)]
    lines = [json.loads(x) for f in glob.glob(f"{path}/reports/window=all/*.json") for x in open(f)]
    assert [c["card"] for c in lines[0]["cards"]] == ["total_hours", "top_tracks"] and [r["place"] for r in lines[0]["cards"][1]["rows"]] == [1, 2]
    assert "PartitionFilters: [isnotnull(window" in reports.read(spark, path, "2023")._jdf.queryExecution().toString()


def test_no_rows_give_no_reports(spark, tmp_path):
    reports.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "r"))
    assert reports.renderings(reports.documents(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("version", ["1.9", "20.1", None])
def test_other_versions_are_refused(spark, tmp_path, version):
    path = str(tmp_path / "r")
    spark.createDataFrame([(version, "all", "all")], "schema_version string, window_id string, window string").write.partitionBy("window").json(f"{path}/reports")
    with pytest.raises(Exception, match="report version"):
        reports.card_rows(reports.read(spark, path)).collect()


def test_renderings_escape_labels(spark):
    got = {r.window_id: r for r in reports.renderings(reports.documents(spark.createDataFrame(ROWS, SCHEMA))).collect()}
    assert '| 2 | a "b" \\| <c> & d | 1,234.5 |' in got["all"].markdown and "| 1 |  |  |" in got["all"].markdown
    assert "<td>a &quot;b&quot; | &lt;c&gt; &amp; d</td><td>1,234.5</td>" in got["all"].html
    assert got["2023"].markdown == "# Report: 2023\n\n## total_hours\n\n| place | what | value |\n| --- | --- | --- |\n|  | x | 2 |\n"
