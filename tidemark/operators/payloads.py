"""Nested payloads whose shape differs from row to row, as VARIANT: no schema is fixed, and broken ones are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

#: Where the list of entries, and an entry's track, may be, in the order they are looked for.
LISTS = ("$.items", "$.tracks.items", "$.tracks", "$")
TRACKS = ("$.track", "$.item", "$")


def parsed(payloads: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `payload` as VARIANT, rows that hold no JSON). Null texts are of the second kind."""
    own = payloads.withColumn("payload", F.try_parse_json(text))
    return own.where("payload is not null"), own.where("payload is null").drop("payload")


def _first(v: str, paths: list[str] | tuple[str, ...], kind: str) -> Column:
    """The value at the first path that has one of this kind."""
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in paths])


def tracks(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, place, id, name, artist) of the entries of each payload that have an id; of repeated ids the first stays.

    The artist is the first of a list, or a single one; each may be an object with a name, or a name.
    """
    entry = payloads.select(key, F.posexplode(_first(payload, LISTS, "array<variant>")).alias("place", "entry"))
    at = lambda *fields: _first("entry", [t + f for f in fields for t in TRACKS], "string")
    got = entry.select(key, F.col("place").cast("long").alias("place"), at(".id").alias("id"), at(".name").alias("name"), at(".artists[0].name", ".artist.name", ".artists[0]", ".artist").alias("artist"))
    return ranks.keep_one(got.where("id is not null"), [key, "id"], ["place"])


def fields(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(field, kind, n): the top-level fields of all payloads that are objects, with how many rows have each kind of value."""
    entries = payloads.select(F.explode(F.map_entries(F.try_variant_get(payload, "$", "map<string,variant>"))).alias("e"))
    kind = F.regexp_extract(F.schema_of_variant(F.col("e.value")), "^[A-Z]+", 0)
    return entries.groupBy(F.col("e.key").alias("field"), kind.alias("kind")).agg(F.count("*").alias("n"))
