"""The registry of named queries, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Decimal places that compared doubles are rounded to.
PLACES = 6


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded and small integers widened, so that engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, PLACES) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = "", dates: str = ""):
    """Register a query; `doubles` and `longs` name the columns of the SQL to round and widen."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            casts = [f"ROUND(CAST({c} AS DOUBLE), {PLACES}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS q" if casts else sql
        return f

    return add


# Common table expressions of the SQL: the adapters and the derived tables, said again.
_REASON = "CASE event_type WHEN 'purchase' THEN 'trackdone' WHEN 'signup' THEN 'backbtn' WHEN 'click' THEN 'fwdbtn' WHEN 'view' THEN 'endplay' ELSE 'other' END"
_RAW = f"""raw AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS artist_name, user_id || '-' || (event_id % 10) AS track_id, 'Song ' || user_id || '-' || (event_id % 10) AS track_name,
    user_id || '/' || (event_id % 3) || CASE WHEN event_id % 2 = 1 THEN ' (Remastered)' ELSE '' END AS album_name, CAST(ROUND(value * 1000) AS BIGINT) AS ms_played, {_REASON} AS reason_end FROM events)"""
PLAYS = f"""{_RAW}, shares AS (SELECT *, LEAST(COALESCE(CAST(ms_played AS DOUBLE) / NULLIF(MAX(ms_played) OVER (PARTITION BY track_id), 0), 0), 1) AS completion FROM raw),
plays AS (SELECT *, CASE WHEN reason_end IN ('trackdone', 'backbtn') THEN 1 WHEN reason_end = 'fwdbtn' AND completion < 0.8 THEN -1 WHEN reason_end = 'endplay' AND completion < 0.3 THEN -1 ELSE 0 END AS verdict,
    YEAR(ts) AS year, MONTH(ts) AS month, HOUR(ts) AS hour_utc, ISODOW(ts) - 1 AS dow FROM shares)"""
TRACKS = f"""{PLAYS}, tracks AS (SELECT track_id, MIN(track_name) AS name, MIN(artist_name) AS artist, MIN(album_name) AS album, MIN(ts) AS first_played, MAX(ts) AS last_played, COUNT(*) AS play_count, CAST(SUM(ms_played) AS BIGINT) AS total_ms,
    AVG(CASE WHEN reason_end = 'fwdbtn' THEN 1.0 ELSE 0.0 END) AS skip_rate, AVG(completion) AS mean_completion, CAST(SUM(verdict) AS BIGINT) AS net_verdict FROM plays GROUP BY track_id)"""
ORDERS = """long_plays AS (SELECT o_orderkey AS event_id, o_orderdate AS ts, CAST(o_custkey AS VARCHAR) AS artist_name, o_orderpriority || o_custkey AS track_id, CAST(ROUND(o_totalprice) AS BIGINT) AS ms_played FROM orders),
months AS (SELECT artist_name AS artist, date_trunc('month', ts) AS month, COUNT(*) AS play_count, CAST(SUM(ms_played) AS BIGINT) AS total_ms FROM long_plays GROUP BY 1, 2)"""
