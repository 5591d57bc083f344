"""Reports of all windows as files: a JSON document and an index entry for each window, and the same as Markdown and HTML.

Input is the table of card rows that `operators.cards.report` makes: window_id, card_no, card, place, label, value. What one
window holds is bounded by the cards (tops, 24 hours, decades, clusters), so a document is a row; windows are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Of a document: readers refuse those of another major version.
SCHEMA_VERSION = "2.1"
_ROWS = "array<struct<place:long,label:string,value:double>>"
DOCUMENT = f"schema_version string, window_id string, cards array<struct<card_no:long,card:string,rows:{_ROWS}>>"


def documents(rows: DataFrame) -> DataFrame:
    """schema_version, window_id and cards: a row for each window, cards and their rows in order. Null places, labels and values stay."""
    per = rows.groupBy("window_id", "card_no", "card").agg(F.array_sort(F.collect_list(F.struct("place", "label", "value"))).alias("rows"))
    got = per.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("card_no", "card", "rows"))).alias("cards"))
    return got.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "window_id", "cards")


def write(rows: DataFrame, path: str) -> None:
    """A folder with the documents as JSON lines, in a folder for each window, and their index: what each holds."""
    made = documents(rows)
    made.withColumn("window", F.col("window_id")).write.partitionBy("window").option("ignoreNullFields", False).json(f"{path}/reports")
    read(rows.sparkSession, path).select("window_id", F.size("cards").alias("cards"), F.aggregate("cards", F.lit(0), lambda n, c: n + F.size(c["rows"])).alias("rows")).write.json(f"{path}/index")


def read(spark: SparkSession, path: str, *windows: str) -> DataFrame:
    """The documents of a folder; with windows, only their folders are read. A document of another major version: an error."""
    got = spark.read.schema(f"{DOCUMENT}, window string").json(f"{path}/reports")
    got = got.where(F.col("window").isin(*windows)) if windows else got
    fits = F.split_part("schema_version", F.lit("."), F.lit(1)) == SCHEMA_VERSION.split(".")[0]
    refused = F.raise_error(F.concat(F.lit("report version "), F.coalesce("schema_version", F.lit("missing")), F.lit(f" is not {SCHEMA_VERSION}")))
    return got.select(F.when(fits, F.col("schema_version")).otherwise(refused).alias("schema_version"), "window_id", "cards")


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("window_id string, cards long, rows long").json(f"{path}/index")


def card_rows(made: DataFrame) -> DataFrame:
    """Documents as the rows they were made of. The version is looked at, so that a document that doesn't fit is refused."""
    card = made.where(F.col("schema_version").isNotNull()).select("window_id", F.explode("cards").alias("c"))
    return card.select("window_id", "c.card_no", "c.card", F.explode("c.rows").alias("r")).select("window_id", "card_no", "card", "r.*")


def _escaped(c: Column) -> Column:
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def _body(card_of, row_of, between: str) -> Column:
    inner = lambda c: F.array_join(F.transform(c["rows"], row_of), between)
    return F.array_join(F.transform("cards", lambda c: card_of(c["card"], inner(c))), between)


def renderings(made: DataFrame) -> DataFrame:
    """window_id, markdown, html. Bars of Markdown tables are escaped in labels, marks of HTML too; null labels are empty."""
    said = lambda r: F.coalesce(r["label"], F.lit(""))
    cells = lambda r, label, a, b, z: F.concat(F.lit(a), F.coalesce(r["place"].cast("string"), F.lit("")), F.lit(b), label, F.lit(b), text.cell(r["value"]), F.lit(z))
    heading = F.concat(F.lit("Report: "), F.when(F.col("window_id") == "all", F.lit("all time")).otherwise(F.col("window_id")))
    table = _body(lambda card, rows: F.concat(F.lit("\n## "), card, F.lit("\n\n| place | what | value |\n| --- | --- | --- |\n"), rows), lambda r: cells(r, F.replace(said(r), F.lit("|"), F.lit("\\|")), "| ", " | ", " |"), "\n")
    page = _body(lambda card, rows: F.concat(F.lit("<h2>"), card, F.lit("</h2><table>"), rows, F.lit("</table>")), lambda r: cells(r, _escaped(said(r)), "<tr><td>", "</td><td>", "</td></tr>"), "")
    return made.select("window_id", F.concat(F.lit("# "), heading, F.lit("\n"), table, F.lit("\n")).alias("markdown"), F.concat(F.lit("<!doctype html><title>"), heading, F.lit("</title><h1>"), heading, F.lit("</h1>"), page).alias("html"))
