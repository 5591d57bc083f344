"""File sources and sinks beyond Spark's own formats."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.feather
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.governance import check_crate

_MEMBER = re.compile(r"(^|/)Streaming_History_Audio_[^/]*\.json$")
RAW_SCHEMA = "ts string, platform string, ms_played long, conn_country string, ip_addr string, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string, reason_start string, reason_end string, shuffle boolean, skipped boolean, offline boolean, offline_timestamp long, incognito_mode boolean"


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for where, content in zip(f["path"], f["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = sorted(n for n in z.namelist() if _MEMBER.search(n))
                if not names:
                    raise ValueError(f"{where} holds no audio history")
                for n in names:
                    yield pd.DataFrame({"line": [json.dumps(r) for r in json.loads(z.read(n))]})


def history_records(archives: DataFrame) -> DataFrame:
    """Raw play records of zipped exports (path, content): their audio history members. No such member: an error."""
    lines = archives.select("path", "content").mapInPandas(_members, "line string")
    return lines.select(F.from_json("line", RAW_SCHEMA).alias("r")).select("r.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return history_records(spark.read.format("binaryFile").load(path))


def pack_history(records: DataFrame, most: int = 20_000) -> DataFrame:
    """Play records as zipped exports (path, content): each task deals its records into archives of at most `most`."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start in range(0, len(f), most):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("export/Streaming_History_Audio_0.json", "[" + ",".join(f["line"].iloc[start : start + most]) + "]")
                    z.writestr("export/ReadMe.json", "[]")
                yield pd.DataFrame({"path": [f"history-{start}.zip"], "content": [out.getvalue()]})

    return records.select(F.to_json(F.struct("*")).alias("line")).mapInPandas(pack, "path string, content binary")


def read_last_wins(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines of which a later one replaces an earlier one of its key. Lines are ordered by file, then place in it.

    Large files are read in splits: a line's place is where its split begins, then its number in the task, which rises.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")).alias("_place")
    lines = spark.read.text(path).select(place, "value").where(F.trim("value") != "")
    rows = lines.select("_place", F.from_json("value", schema).alias("r"))
    return rows.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", "_place").alias("r")).select("r.*")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True).select(*columns)


def parse_feather(columns: list[str]):
    """For mapInArrow over Arrow IPC files (content): their rows, of the given columns."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from pa.feather.read_table(io.BytesIO(content.as_py()), columns=columns).to_batches()

    return parse


def pack_feather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: each batch of rows as an Arrow IPC file (content)."""
    for batch in batches:
        out = io.BytesIO()
        pa.feather.write_feather(pa.Table.from_batches([batch]), out)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["content"])


def read_feather(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Arrow IPC files, read on the executors through Spark's file systems."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse_feather(columns), schema)


def save_crate(crate: DataFrame, path: str, **about: str) -> None:
    """Write a crate that passes the schema rule, with facts about it in the columns' metadata."""
    check_crate(crate).withMetadata("track_id", about).write.mode("overwrite").parquet(path)


def load_crate(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    df = check_crate(spark.read.parquet(path))
    return df, dict(df.schema["track_id"].metadata)


def encode_gaps(cells: list[int]) -> bytes:
    """Ascending cells as gaps: one byte each, or 0 and two bytes, little-endian, from 256."""
    out, before = bytearray(), -1
    for c in cells:
        gap = c - before
        out += bytes([gap]) if gap < 256 else b"\0" + gap.to_bytes(2, "little")
        before = c
    return bytes(out)


def decode_gaps(data: bytes) -> list[int]:
    out, at, cell = [], 0, -1
    while at < len(data):
        if data[at]:
            cell += data[at]
            at += 1
        else:
            cell += int.from_bytes(data[at + 1 : at + 3], "little")
            at += 3
        out.append(cell)
    return out


def history_of(catalogue: DataFrame, most: int = 20, start: int = 1672531200, days: int = 365) -> DataFrame:
    """A made-up history of the tracks of a catalogue (track_id, artist_name): one to `most` plays each, few of most tracks.

    All of it follows from hashes of the track and the play's number, so that any engine can repeat it.
    """
    draw = lambda what, *k: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(what), *[F.col(c).cast("string") for c in k])), 1, 8), 16, 10).cast("long")
    plays = catalogue.select("track_id", "artist_name", F.explode(F.sequence(F.lit(1), 1 + F.floor(F.pow(draw("n", "track_id") / 2**32, 3) * most).cast("int"))).alias("play"))
    at = lambda what: draw(what, "track_id", "play")
    reason = F.when(at("reason") % 5 == 0, "fwdbtn").otherwise("trackdone")
    return plays.select("track_id", "play", "artist_name", F.timestamp_seconds(start + at("ts") % (days * 86400)).alias("ts"), (30000 + at("ms") % 200000).alias("ms_played"), reason.alias("reason_end"))


def sample_history(spark: SparkSession, n: int, tracks: int = 300, seed: int = 7) -> DataFrame:
    """A made-up history for fixtures: Zipf-like popularity, plays about four minutes apart."""
    r = lambda k: F.rand(seed + k)
    track = F.floor(F.pow(r(0), 2.5) * tracks).cast("int")
    t = F.timestamp_seconds(1672531200 + F.col("id") * 240 + F.floor(r(1) * 200))
    return spark.range(n).select(F.col("id").alias("event_id"), t.alias("ts"), F.concat(F.lit("t"), track.cast("string")).alias("track_id"), F.concat(F.lit("a"), (track % 40).cast("string")).alias("artist_name"), F.floor(30000 + r(2) * 200000).cast("long").alias("ms_played"), F.when(r(3) < 0.2, "fwdbtn").otherwise("trackdone").alias("reason_end"))
