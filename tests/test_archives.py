"""What archives hold is judged too: members by their own names and contents; broken archives don't end the job."""

import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import governance, taste
from tidemark.plans import report
from tidemark.sources import files


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_members_of_archives(spark):
    token = '"refresh_token": "' + "a" * 24 + '"'
    files = [
        ("a/plain.txt", token.encode()), ("a/clean.txt", b"nothing"), ("a/empty.txt", None), ("a/x.zip", zipped(**{"ok.txt": "fine", "data__k.txt": "x", "Streaming_History_1.json": "[]", "in.json": '"ip_addr": "8.8.8.8"'})),
        ("web/public/rewind/r.json.gz", gzip.compress(b'{"audience": "private"}')), ("a/broken.zip", b"PK\x03\x04 no archive"), ("a/broken.gz", b"\x1f\x8bno"), ("a/raw.bin", b"\xff\xfe\x00"), ("a/.env", b""),
    ]
    got = {tuple(r) for r in governance.archive_problems(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {
        ("a/plain.txt", None, "refresh token"), ("a/x.zip", "data/k.txt", "derived from personal data"), ("a/x.zip", "in.json", "ip_addr value"),
        ("web/public/rewind/r.json.gz", "r.json", "private report"), ("web/public/rewind/r.json.gz", "r.json", "public report not marked synthetic"), ("a/.env", None, "raw export or secrets"),
    }


def test_large_members_are_read_in_bounds(spark, monkeypatch):
    text = "x" * 100 + '"ip_addr": "8.8.8.8"'
    files = spark.createDataFrame([("b.zip", zipped(**{"m.txt": text}))], "path string, content binary")
    assert governance.archive_problems(files).count() == 1
    assert governance.unpacked(files).first().text == text


def test_history_goes_through_archives_of_bounded_size(spark):
    records = spark.range(25).select(F.col("id").alias("ms_played"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('Ti"tle\n'), F.col("id").cast("string"))).alias("master_metadata_track_name"))
    archives = files.pack_history(records.coalesce(1), most=10)
    assert archives.count() == 3
    got = sorted((r.ms_played, r.master_metadata_track_name) for r in files.history_records(archives).collect())
    assert got == sorted((i, f'Ti"tle\n{i}' if i % 5 else None) for i in range(25))
    assert files.history_records(files.pack_history(records.limit(0))).collect() == []


def test_arrow_files_keep_rows(spark):
    rows = [(1, [1.0, None], None), (2, None, "x"), (2, [], "")]
    df = spark.createDataFrame(rows, "k long, v array<double>, s string")
    got = df.mapInArrow(files.pack_feather, "content binary").mapInArrow(files.parse_feather(["k", "s"]), "k long, s string")
    assert sorted((r.k, str(r.s)) for r in got.collect()) == [(1, "None"), (2, ""), (2, "x")]


def test_columns_say_what_the_plain_functions_say(spark):
    values = [None, 0.0, 100.0, 1234.5, 0.125, 1234567.891, -1500.25, 0.0004]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", text.cell("x").alias("c"), text.cell(F.round("x").cast("long"), whole=True).alias("w")).orderBy("i").collect()
    assert [r.c for r in got] == [report.cell(x) for x in values]
    assert got[0].w == "" and got[5].w == report.cell(1234568)
    assert spark.range(1).select(text.config_hash(F.lit('{"a": 1}'))).first()[0] == report.config_hash({"a": 1})
    for version in ("2.1", "2.9", "1.0", "", "20.1"):
        plain = True
        try:
            report.check_version({"schema_version": version})
        except ValueError:
            plain = False
        assert spark.range(1).select(report.readable(F.lit(version))).first()[0] == plain
    for rate, decay in ((0.05, 0.01), (1.0, 0.0), (0.0, 0.1), (0.5, 1.0), (1.5, 0.1)):
        if spark.range(1).select(taste.valid(F.lit(rate), F.lit(decay))).first()[0]:
            taste.check(rate, decay)
        else:
            with pytest.raises(ValueError):
                taste.check(rate, decay)


def test_noise_is_normal_and_repeatable(spark):
    keys = spark.range(4000).select(F.explode(text.noise("id", 3)).alias("x"))
    mean, sd, far = keys.agg(F.avg("x"), F.stddev("x"), F.avg((F.abs("x") > 1.96).cast("int"))).first()
    assert abs(mean) < 0.03 and abs(sd - 1) < 0.03 and 0.04 < far < 0.06
    assert keys.where("x is null or isnan(x)").count() == 0 and keys.exceptAll(keys).count() == 0
