"""Queries: joins, aggregates, scalars, similarity, taste, metrics, resolution and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsontext, music, text
from ..operators import evaluation, governance, payloads, ranks, resolve, similarity, taste, warehouse
from ..sources.adapters import table
from .queries_listening import HOURLY, long_plays, months, plays, titles, tracks
from .registry import ORDERS, PLAYS, TRACKS, query

# --- joins ----------------------------------------------------------------------------------------------------------


@query("jn1_left_join_conditional", f"WITH {TRACKS} SELECT t.track_id, MAX(CASE WHEN p.reason_end = 'trackdone' THEN p.ms_played END) AS duration_ms FROM tracks t LEFT JOIN plays p USING (track_id) GROUP BY 1")
def _(s, d):
    own = plays(s, d)
    done = F.max(F.when(F.col("reason_end") == "trackdone", F.col("ms_played")))
    return warehouse.tracks(own).select("track_id").join(own, "track_id", "left").groupBy("track_id").agg(done.alias("duration_ms"))


@query("jn2_anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_LAPSED = "SELECT c_custkey, COUNT(*) AS n, MAX(o_orderdate) AS last_order FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey % 2 = 0 GROUP BY 1 HAVING COUNT(*) >= 5 AND MAX(o_orderdate) < (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 90 DAYS"


@query("jn3_join_scalar", _LAPSED)
def _(s, d):
    o = table(s, d, "orders")
    cut = F.broadcast(o.agg((F.max("o_orderdate") - F.expr("INTERVAL 90 DAYS")).alias("cut")))
    got = table(s, d, "customer").where("c_custkey % 2 = 0").join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    return got.where("n >= 5").crossJoin(cut).where("last_order < cut").drop("cut")


@query("jn4_four_way", "SELECT n_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def _(s, d):
    o, c, n, r = (table(s, d, t) for t in ("orders", "customer", "nation", "region"))
    got = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return got.groupBy("n_name").agg(F.count("*").alias("n"))


@query("jn5_left_enrich", "SELECT d.doc_id, COALESCE(quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)", longs="quality")
def _(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("jn6_membership", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_label FROM documents")
def _(s, d):
    marks = table(s, d, "labels").select("doc_id").distinct().withColumn("m", F.lit(True))
    return table(s, d, "documents").join(marks, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit(False)).alias("has_label"))


@query("jn7_semi_both_sides", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1, 2", longs="l_linenumber")
def _(s, d):
    p, u = table(s, d, "part").where("p_size > 40"), table(s, d, "supplier").where("s_acctbal > 5000")
    got = table(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(u, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return got.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("jn8_derived_key", "SELECT d.doc_id, n.n_nationkey FROM documents d JOIN nation n ON CAST(regexp_replace(d.source, '[^0-9]', '', 'g') AS INTEGER) = n.n_nationkey", longs="n_nationkey")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.regexp_replace("source", "[^0-9]", "").cast("int").alias("n_nationkey"))
    return docs.join(table(s, d, "nation"), "n_nationkey").select("doc_id", "n_nationkey")


@query("jn13_keyed_lookup", "SELECT COUNT(*) AS plays, COUNT(*) FILTER (l.doc_id IS NOT NULL) AS matched, COUNT(DISTINCT l.doc_id) AS rows_matched FROM events e LEFT JOIN labels l ON l.doc_id = e.user_id")
def _(s, d):
    got = table(s, d, "events").join(table(s, d, "labels"), F.col("doc_id") == F.col("user_id"), "left")
    return got.agg(F.count("*").alias("plays"), F.count_if(F.col("doc_id").isNotNull()).alias("matched"), F.count_distinct("doc_id").alias("rows_matched"))


@query("res5_reconcile", f"SELECT 'never_played' AS kind, c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'not_saved', o_custkey FROM orders WHERE o_custkey % 2 = 1 UNION ALL SELECT 'lapsed', c_custkey FROM ({_LAPSED})")
def _(s, d):
    o, saved = table(s, d, "orders"), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    played = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    cut = F.broadcast(played.agg((F.max("last") - F.expr("INTERVAL 90 DAYS")).alias("cut")))
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "k")
    lapsed = saved.join(played.where("n >= 5"), "k").crossJoin(cut).where("last < cut")
    return kind(saved.join(played, "k", "left_anti"), "never_played").unionByName(kind(played.join(saved, "k", "left_anti"), "not_saved")).unionByName(kind(lapsed, "lapsed"))


# --- aggregates -----------------------------------------------------------------------------------------------------

_YEARS = "years AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 1960 + p_size END AS year, p_partkey % 5 AS plays FROM part)"


def years(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("id"), F.when(k % 7 != 0, 1960 + F.col("p_size")).alias("year"), (k % 5).alias("plays"))


@query("agg10_decades", f"WITH {_YEARS} SELECT CAST(FLOOR(year / 10) * 10 AS BIGINT) AS decade, CAST(SUM(plays) AS BIGINT) AS plays, SUM(plays) / SUM(SUM(plays)) OVER () AS share FROM years WHERE year IS NOT NULL GROUP BY 1", "share")
def _(s, d):
    per = years(s, d).where("year is not null").groupBy((F.floor(F.col("year") / 10) * 10).alias("decade")).agg(F.sum("plays").alias("plays"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("plays").alias("t")))).select("decade", "plays", (F.col("plays") / F.col("t")).alias("share"))


@query("agg11_weighted_median", f"WITH {_YEARS}, r AS (SELECT year FROM years, range(5) WHERE range < plays AND year IS NOT NULL) SELECT CAST(FLOOR(median(year)) AS BIGINT) AS listening_year FROM r")
def _(s, d):
    return years(s, d).where("year is not null and plays > 0").agg(F.percentile("year", 0.5, F.col("plays")).cast("int").alias("listening_year"))


@query("agg12_share_below", f"WITH {_YEARS} SELECT SUM(CASE WHEN year < 1980 THEN plays ELSE 0 END) / SUM(plays) AS share FROM years WHERE year IS NOT NULL", "share")
def _(s, d):
    return years(s, d).where("year is not null").agg((F.sum(F.when(F.col("year") < 1980, F.col("plays")).otherwise(0)) / F.sum("plays")).alias("share"))


@query("agg13_oldest", f"WITH {_YEARS} SELECT id, year FROM years WHERE year IS NOT NULL ORDER BY year, plays DESC, id LIMIT 1", longs="year")
def _(s, d):
    return ranks.top(years(s, d).where("year is not null").select("id", "year", "plays"), 1, "year", F.desc("plays"), "id").drop("plays")


@query("agg14_coverage", f"WITH {_YEARS} SELECT COUNT(*) FILTER (year IS NOT NULL) AS tracks_used, COUNT(*) AS tracks_of, CAST(SUM(CASE WHEN year IS NOT NULL THEN plays END) AS BIGINT) AS plays_used, CAST(SUM(plays) AS BIGINT) AS plays_of FROM years")
def _(s, d):
    return years(s, d).agg(F.count("year").alias("tracks_used"), F.count("*").alias("tracks_of"), F.sum(F.when(F.col("year").isNotNull(), F.col("plays"))).alias("plays_used"), F.sum("plays").alias("plays_of"))


_FIRST = f"{PLAYS}, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY ts, event_id) = 1 AS first FROM plays), w AS (SELECT * FROM f WHERE ts >= TIMESTAMP '2024-01-10')"


def windowed(s: SparkSession, d: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("track_id").orderBy("ts", "event_id")) == 1
    return warehouse.between(plays(s, d).withColumn("first", first), "2024-01-10")


@query("agg15_discovery_ratio", f"WITH {_FIRST} SELECT AVG(CAST(first AS INTEGER)) AS ratio FROM w", "ratio")
def _(s, d):
    return windowed(s, d).agg(F.avg(F.col("first").cast("int")).alias("ratio"))


@query("agg16_top_percent", f"WITH {PLAYS}, c AS (SELECT track_id, COUNT(*) AS n FROM plays GROUP BY 1), r AS (SELECT n, ROW_NUMBER() OVER (ORDER BY n DESC) AS k, GREATEST(1, COUNT(*) OVER () // 100) AS m, SUM(n) OVER () AS t FROM c) SELECT SUM(n) / MAX(t) AS share FROM r WHERE k <= m", "share")
def _(s, d):
    c = plays(s, d).groupBy("track_id").agg(F.count("*").alias("n"))
    # tracks with equal counts are alike, so counts are ranked, not tracks
    by = c.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("n"))
    r = by.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(by.agg(F.greatest(F.lit(1), F.floor(F.sum("k") / 100)).alias("m"), F.sum(F.col("n") * F.col("k")).alias("t"))))
    taken = F.greatest(F.lit(0), F.least(F.col("k"), F.col("m") - (F.col("upto") - F.col("k"))))
    return r.agg((F.sum(taken * F.col("n")) / F.max("t")).alias("share"))


@query("agg17_monthly_support", f"WITH {_FIRST} SELECT date_trunc('week', ts) AS week, COUNT(*) AS n, AVG(CAST(first AS INTEGER)) AS ratio FROM w GROUP BY 1 HAVING COUNT(*) >= 100", "ratio")
def _(s, d):
    return windowed(s, d).groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n"), F.avg(F.col("first").cast("int")).alias("ratio")).where("n >= 100")


@query("agg18_evenness", "WITH c AS (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1), p AS (SELECT n / SUM(n) OVER () AS p FROM c) SELECT -SUM(p * ln(p)) / ln(COUNT(*)) AS evenness FROM p", "evenness")
def _(s, d):
    return evaluation.shannon_evenness(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "n")


@query("agg19_old_share", f"WITH {_YEARS} SELECT SUM(CASE WHEN year < 2010 - 20 THEN plays ELSE 0 END) / SUM(plays) AS old_share FROM years WHERE year IS NOT NULL AND plays > 0", "old_share")
def _(s, d):
    return years(s, d).where("year is not null and plays > 0").agg((F.sum(F.when(F.col("year") < 1990, F.col("plays")).otherwise(0)) / F.sum("plays")).alias("old_share"))


_PRED = f"""{PLAYS}, t AS (SELECT *, ts < TIMESTAMP '2024-01-20' AS train, CAST(verdict < 0 AS INTEGER) AS y FROM plays WHERE verdict <> 0), a AS (SELECT track_id, AVG(y) AS v FROM t WHERE train GROUP BY 1), b AS (SELECT artist_name, AVG(y) AS v FROM t WHERE train GROUP BY 1),
    scored AS (SELECT event_id, y, a.v IS NOT NULL AS seen, COALESCE(a.v, b.v, (SELECT AVG(y) FROM t WHERE train)) AS score FROM t LEFT JOIN a USING (track_id) LEFT JOIN b USING (artist_name) WHERE NOT train)"""


def scored(s: SparkSession, d: str) -> DataFrame:
    from ..operators.listening import rate_predictor

    p = plays(s, d).where("verdict <> 0").withColumn("y", (F.col("verdict") < 0).cast("int"))
    train = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    seen = p.where(train).select("track_id").distinct().withColumn("seen", F.lit(True))
    return rate_predictor(p, "y", train).join(seen, "track_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


@query("agg21_rate_predictor", f"WITH {_PRED} SELECT event_id, score FROM scored", "score")
def _(s, d):
    return scored(s, d).select("event_id", "score")


@query("agg29_auc", f"""WITH {_PRED}, r AS (SELECT seen, y, RANK() OVER (PARTITION BY seen ORDER BY score) + (COUNT(*) OVER (PARTITION BY seen, score) - 1) / 2.0 AS r FROM scored)
    SELECT seen, (SUM(CASE WHEN y = 1 THEN r ELSE 0 END) - SUM(y) * (SUM(y) + 1) / 2) / NULLIF(SUM(y) * (COUNT(*) - SUM(y)), 0) AS auc FROM r GROUP BY 1""", "auc")
def _(s, d):
    return evaluation.auc(scored(s, d), "score", "y", ["seen"])


_TAGS = "tags AS (SELECT doc_id, lang, unnest(list_distinct([lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END])) AS tag FROM documents)"


@query("agg22_tag_lift", f"WITH {_TAGS}, l AS (SELECT tag, COUNT(*) / (SELECT COUNT(*) FROM documents) AS r FROM tags GROUP BY 1), c AS (SELECT lang, COUNT(*) AS n FROM documents GROUP BY 1), g AS (SELECT lang, tag, COUNT(*) AS k FROM tags GROUP BY 1, 2) SELECT g.lang, g.tag, k / n AS rate, k / n / r AS lift FROM g JOIN l USING (tag) JOIN c ON c.lang = g.lang", "rate lift")
def _(s, d):
    docs = table(s, d, "documents")
    tags = docs.select("lang", F.explode(F.array_distinct(F.array("lang", "source", F.when(F.col("n_chars") > 2000, "long").otherwise("short")))).alias("tag"))
    lib = tags.groupBy("tag").agg(F.count("*").alias("a")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("b")))).select("tag", (F.col("a") / F.col("b")).alias("r"))
    got = tags.groupBy("lang", "tag").agg(F.count("*").alias("k")).join(docs.groupBy("lang").agg(F.count("*").alias("n")), "lang").join(lib, "tag")
    return got.select("lang", "tag", (F.col("k") / F.col("n")).alias("rate"), (F.col("k") / F.col("n") / F.col("r")).alias("lift"))


@query("agg24_tag_sets", "SELECT lang, COUNT(DISTINCT source) AS sources, MIN(n_chars) AS lo, MAX(n_chars) AS hi, AVG(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY 1", "mean median")
def _(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.avg("n_chars").alias("mean"), F.percentile("n_chars", 0.5).alias("median"))


@query("agg25_correlation", "SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem", "r")
def _(s, d):
    return table(s, d, "lineitem").agg(F.corr("l_quantity", "l_extendedprice").alias("r"))


_EVAL = "e AS (SELECT doc_id, quality AS y, toxic AS z, ((doc_id * 37) % 100) / 100.0 AS p FROM labels)"


def labelled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("z"), ((F.col("doc_id") * 37) % 100 / 100).alias("p"))


@query("agg26_prediction_metrics", f"WITH {_EVAL} SELECT AVG(ABS(p - y)) AS mae, AVG(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS exact, AVG(CASE WHEN y = z THEN 1.0 ELSE 0.0 END) AS same FROM e", "mae exact same")
def _(s, d):
    share = lambda c: F.avg(c.cast("double"))
    return labelled(s, d).agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), share((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("exact"), share(F.col("y") == F.col("z")).alias("same"))


@query("agg27_spearman", "WITH r AS (SELECT RANK() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, RANK() OVER (ORDER BY p_retailprice) + (COUNT(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT corr(a, b) AS spearman FROM r", "spearman")
def _(s, d):
    return evaluation.spearman(table(s, d, "part"), "p_size", "p_retailprice")


@query("agg28_mean_jaccard", "WITH t AS (SELECT string_split(lower(a.text), ' ') AS x, string_split(lower(b.text), ' ') AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT AVG(len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y)))) AS jaccard FROM t", "jaccard")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("x"))
    pair = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    return pair.agg(F.avg(evaluation.jaccard("x", "y")).alias("jaccard"))


@query("agg30_baseline", "SELECT AVG(n_chars) AS mean_chars, (SELECT lang FROM documents GROUP BY lang ORDER BY COUNT(*) DESC, lang LIMIT 1) AS mode_lang, (SELECT source FROM documents GROUP BY source ORDER BY COUNT(*) DESC, source LIMIT 1) AS mode_source FROM documents", "mean_chars")
def _(s, d):
    docs = table(s, d, "documents")
    mode = lambda c: docs.groupBy(c).agg(F.count("*").alias("n")).agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(f"mode_{c}"))
    return docs.agg(F.avg("n_chars").alias("mean_chars")).crossJoin(mode("lang")).crossJoin(mode("source"))


@query("agg31_match_rates", "WITH r AS (SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS m, NTILE(10) OVER (ORDER BY n_chars DESC, doc_id) AS t, ROW_NUMBER() OVER (ORDER BY n_chars DESC, doc_id) AS k, COUNT(*) OVER () AS n FROM documents) SELECT GREATEST(CEIL((k - 1) / ((n - 1) / 10.0)) - 1, 0) AS decile, AVG(CAST(m AS INTEGER)) AS rate FROM r GROUP BY 1", "rate", "decile")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", "n_chars")
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    # a rank over all rows without one task: rows are numbered within lengths, lengths are added up
    per = docs.groupBy("n_chars").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy(F.desc("n_chars")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    k = F.col("before") + F.row_number().over(Window.partitionBy("n_chars").orderBy("doc_id"))
    ranked = docs.join(per, "n_chars").withColumn("k", k).crossJoin(n)
    marks = table(s, d, "labels").select("doc_id").distinct().withColumn("m", F.lit(1))
    return ranked.join(marks, "doc_id", "left").groupBy(ranks.decile(F.col("k"), F.col("n")).alias("decile")).agg(F.avg(F.coalesce("m", F.lit(0))).alias("rate"))


@query("agg33_moments", "WITH l AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT dim, AVG(CAST(v AS DOUBLE)) AS mean, CASE WHEN stddev_pop(CAST(v AS DOUBLE)) = 0 THEN 1 ELSE stddev_pop(CAST(v AS DOUBLE)) END AS sd FROM l GROUP BY 1", "mean sd", "dim")
def _(s, d):
    return similarity.moments(table(s, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda v: v.cast("double"))))


@query("ml10_latency_summary", "SELECT event_type, quantile_cont(value, 0.5) AS median, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY 1", "median lo hi")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("ml9_parity_delta", "WITH a AS (SELECT event_type, AVG(value) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, AVG(value) AS y FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT event_type, y - x AS delta FROM a JOIN b USING (event_type)", "delta")
def _(s, d):
    run = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    return table(s, d, "events").groupBy("event_type").agg((run(1) - run(0)).alias("delta"))


@query("prj7_min_max", "WITH m AS (SELECT MIN(ln(1 + p_retailprice)) AS lo, MAX(ln(1 + p_retailprice)) AS hi FROM part) SELECT p_partkey, CASE WHEN hi = lo THEN 0.5 ELSE (ln(1 + p_retailprice) - lo) / (hi - lo) END AS scaled FROM part, m", "scaled")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", F.log1p("p_retailprice").alias("x"))
    m = F.broadcast(p.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    return p.crossJoin(m).select("p_partkey", F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)).alias("scaled"))


@query("prj8_feature_vector", "SELECT d.doc_id, array_to_string(list_transform([CAST(lang = 'de' AS INTEGER), CAST(lang = 'en' AS INTEGER), CAST(lang = 'es' AS INTEGER), CAST(lang = 'fr' AS INTEGER), COALESCE(quality, 0), CAST(l.doc_id IS NOT NULL AS INTEGER)], lambda x: CAST(x AS VARCHAR)), ',') AS features FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(s, d):
    marks = table(s, d, "labels").select("doc_id", "quality", F.lit(1).alias("m"))
    got = table(s, d, "documents").join(marks, "doc_id", "left")
    parts = [(F.col("lang") == v).cast("int") for v in ("de", "en", "es", "fr")] + [F.coalesce("quality", F.lit(0)), F.coalesce("m", F.lit(0))]
    return got.select("doc_id", F.array_join(F.transform(F.array(*parts), lambda x: x.cast("string")), ",").alias("features"))


@query("arr1_one_hot", "SELECT event_id, array_to_string(list_transform(['click', 'error', 'purchase', 'signup', 'view'], lambda t: CASE WHEN t = event_type THEN '1' ELSE '0' END), '') AS hot FROM events")
def _(s, d):
    vocabulary = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return table(s, d, "events").select("event_id", F.array_join(F.transform(vocabulary, lambda t: F.when(t == F.col("event_type"), "1").otherwise("0")), "").alias("hot"))


@query("arr2_explode", "SELECT doc_id, unnest(string_split(source, 'c')) AS part FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(F.split("source", "c")).alias("part"))


@query("arr4_mean_profile", "WITH c AS (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n / SUM(n) OVER (PARTITION BY user_id) AS share FROM c", "share")
def _(s, d):
    c = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.select("user_id", "event_type", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))


@query("arr5_pooled", "WITH l AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT vec_id, dim % 8 AS j, SUM(CAST(v AS DOUBLE)) AS v FROM l GROUP BY 1, 2", "v", "j")
def _(s, d):
    return similarity.pooled(table(s, d, "embeddings"), 8).select("vec_id", F.posexplode("embedding").alias("j", "v"))


@query("map1_measured", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'balance=' || CAST(CAST(ROUND(c_acctbal) AS BIGINT) AS VARCHAR) || ',' ELSE '' END || 'nation=' || c_nationkey AS measured FROM customer")
def _(s, d):
    m = F.map_filter(F.map_from_arrays(F.array(F.lit("balance"), F.lit("nation")), F.array(F.when(F.col("c_acctbal") > 0, F.round("c_acctbal").cast("long")), F.col("c_nationkey").cast("long"))), lambda k, v: v.isNotNull())
    return table(s, d, "customer").select("c_custkey", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("measured"))


@query("set5_array_sets", "WITH t AS (SELECT conv_id, list_sort(list_distinct(list(role))) AS r FROM conversations GROUP BY 1) SELECT conv_id, len(list_intersect(r, ['user', 'system'])) AS both_n, r = ['assistant', 'user'] AS plain FROM t", longs="both_n")
def _(s, d):
    r = F.array_sort(F.collect_set("role"))
    return table(s, d, "conversations").groupBy("conv_id").agg(r.alias("r")).select("conv_id", F.size(F.array_intersect("r", F.array(F.lit("user"), F.lit("system")))).alias("both_n"), (F.col("r") == F.array(F.lit("assistant"), F.lit("user"))).alias("plain"))


# --- numbers of the planner -----------------------------------------------------------------------------------------

_CRATE = """crate AS (SELECT p_partkey AS track_id, p_brand AS artist, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 60 + (p_retailprice - lo) / (hi - lo) * 120 END AS tempo, p_size / 50.0 AS energy, 120000 + (p_partkey % 240) * 1000 AS duration_ms, p_partkey % 3 = 0 AS familiar FROM part, (SELECT MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM part))"""


def crate(s: SparkSession, d: str) -> DataFrame:
    """Parts as a crate, by a formula that SQL repeats."""
    p, k = table(s, d, "part"), F.col("p_partkey")
    m = F.broadcast(p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))
    tempo = F.when(k % 11 != 0, 60 + (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 120)
    return p.crossJoin(m).select(k.alias("track_id"), F.col("p_brand").alias("artist"), tempo.alias("tempo"), (F.col("p_size") / 50).alias("energy"), (120000 + k % 240 * 1000).alias("duration_ms"), (k % 3 == 0).alias("familiar"), F.concat(F.col("p_name")).alias("name"))


_SHIFT = "LEAST(ABS(b * 0.5 - a) / a, ABS(b - a) / a, ABS(b * 2 - a) / a)"
_PAIRS = f"{_CRATE}, pairs AS (SELECT track_id, tempo AS a, LEAD(tempo) OVER w AS b, ABS(LEAD(energy) OVER w - energy) AS step FROM crate WINDOW w AS (PARTITION BY artist ORDER BY track_id)), shifts AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {_SHIFT} END AS shift FROM pairs)"


def shifts(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("artist").orderBy("track_id")
    c = crate(s, d)
    return c.select("track_id", music.tempo_shift("tempo", F.lead("tempo").over(w)).alias("shift"), F.abs(F.lead("energy").over(w) - F.col("energy")).alias("step"))


@query("mth1_tempo_shift", f"WITH {_PAIRS} SELECT track_id, shift FROM shifts", "shift")
def _(s, d):
    return shifts(s, d).select("track_id", "shift")


@query("mth2_jarring", f"WITH {_PAIRS} SELECT track_id, step > 0.25 OR COALESCE(shift > 0.24, FALSE) OR COALESCE(shift > 0.12 AND step > 0.125, FALSE) AS jarring FROM shifts WHERE step IS NOT NULL")
def _(s, d):
    return shifts(s, d).where("step is not null").select("track_id", music.jarring("shift", "step").alias("jarring"))


@query("mth3_arc", "SELECT i, CASE WHEN t < 0.15 THEN 'opener' WHEN t < 0.55 THEN 'build' WHEN t < 0.8 THEN 'peak' ELSE 'comedown' END AS phase, 0.3 + 0.5 * CASE WHEN t < 0.15 THEN 0.2 WHEN t < 0.55 THEN 0.2 + 0.7 * (t - 0.15) / 0.4 WHEN t < 0.8 THEN 0.95 ELSE 0.95 - 0.7 * (t - 0.8) / 0.2 END AS target FROM (SELECT p_partkey AS i, CAST(p_partkey % 21 AS DOUBLE) / 20 AS t FROM part)", "target")
def _(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("i"), (k % 21 / 20).alias("t")).select("i", music.phase("t").alias("phase"), music.target("t", 0.3, 0.8).alias("target"))


@query("mth4_dice", "WITH t AS (SELECT s_suppkey % 5 AS a, s_nationkey % 4 AS b, s_suppkey FROM supplier) SELECT s_suppkey, CASE WHEN a + b > 0 THEN 1 - ABS(a - b) / (a + b) ELSE 0 END AS dice FROM t", "dice")
def _(s, d):
    t = table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("a"), (F.col("s_nationkey") % 4).alias("b"))
    return t.select("s_suppkey", music.dice(F.abs(F.col("a") - F.col("b")), "a", "b").alias("dice"))


@query("mth5_measured_energy", "WITH m AS (SELECT median(CASE WHEN p_partkey % 13 <> 0 THEN p_size END) AS m FROM part), x AS (SELECT p_partkey, 0.5 * COALESCE(CASE WHEN p_partkey % 13 <> 0 THEN p_size END, m) + 0.25 * (p_partkey % 17) + 0.25 * (p_partkey % 5) AS x FROM part, m) SELECT p_partkey, (RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0) / COUNT(*) OVER () AS energy FROM x", "energy")
def _(s, d):
    k = F.col("p_partkey")
    p = table(s, d, "part").select(k, F.when(k % 13 != 0, F.col("p_size")).alias("v"))
    m = F.broadcast(p.agg(F.percentile("v", 0.5).alias("m")))
    x = p.crossJoin(m).select("p_partkey", (0.5 * F.coalesce("v", "m") + 0.25 * (k % 17) + 0.25 * (k % 5)).alias("x"))
    return ranks.percent_rank(x, "x", "energy").select("p_partkey", "energy")


@query("mth6_validity", "SELECT p_partkey, CASE WHEN p_size * 4 >= 40 THEN p_size * 4 END AS tempo, CASE WHEN p_partkey % 300 * 1000 >= 60000 THEN p_partkey % 300 * 1000 ELSE 210000 END AS duration_ms FROM part", longs="tempo duration_ms")
def _(s, d):
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", music.valid_tempo(F.col("p_size") * 4).alias("tempo"), music.duration(k % 300 * 1000).alias("duration_ms"))


@query("mth7_cosine", "WITH c AS (SELECT user_id, COUNT(*) FILTER (event_type = 'view') AS a, COUNT(*) FILTER (event_type = 'click') AS b, COUNT(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY 1) SELECT user_id, COALESCE((a + c) / NULLIF(sqrt(a * a + b * b + c * c) * sqrt(2), 0), 0) AS cosine FROM c", "cosine")
def _(s, d):
    n = lambda t: F.count_if(F.col("event_type") == t).cast("double")
    v = table(s, d, "events").groupBy("user_id").agg(F.array(n("view"), n("click"), n("purchase")).alias("v"))
    q = F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return v.select("user_id", F.coalesce(F.try_divide(dot("v", q), F.sqrt(dot("v", "v")) * F.sqrt(dot(q, q))), F.lit(0.0)).alias("cosine"))


@query("mth8_rounding", "SELECT s_suppkey, ROUND(s_acctbal, 1) AS one FROM supplier", "one")
def _(s, d):
    return table(s, d, "supplier").select("s_suppkey", F.round("s_acctbal", 1).alias("one"))


@query("win17_transitions", f"WITH {_CRATE} SELECT track_id, LAG(energy) OVER (PARTITION BY artist ORDER BY track_id) AS before FROM crate", "before")
def _(s, d):
    return crate(s, d).select("track_id", F.lag("energy").over(Window.partitionBy("artist").orderBy("track_id")).alias("before"))


@query("win18_midpoints", f"WITH {_CRATE} SELECT track_id, (SUM(duration_ms) OVER (PARTITION BY artist ORDER BY track_id) - duration_ms / 2.0) / SUM(duration_ms) OVER (PARTITION BY artist) AS mid FROM crate", "mid")
def _(s, d):
    w = Window.partitionBy("artist")
    return crate(s, d).select("track_id", ((F.sum("duration_ms").over(w.orderBy("track_id")) - F.col("duration_ms") / 2) / F.sum("duration_ms").over(w)).alias("mid"))


# --- similarity -----------------------------------------------------------------------------------------------------

N_KC, HASH = 120, 12
_EDGES = f"edges AS (SELECT kc, dim FROM (SELECT k.range AS kc, j.range AS dim, ROW_NUMBER() OVER (PARTITION BY k.range ORDER BY md5(k.range || '-' || j.range)) AS r FROM range({N_KC}) k, range(64) j) WHERE r <= 6)"
_ACT = f"""{_EDGES}, l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT dim, AVG(v) AS mean, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sd FROM l GROUP BY 1),
    z AS (SELECT vec_id, dim, GREATEST(0, (v - mean) / sd) AS z FROM l JOIN m USING (dim)), act AS (SELECT vec_id, kc, ROUND(SUM(z), 9) AS a FROM z JOIN edges USING (dim) GROUP BY 1, 2)"""
_PRINTS = f"{_ACT}, kcs AS (SELECT vec_id, kc FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY a DESC, kc) AS r FROM act) WHERE r <= {HASH}), prints AS (SELECT vec_id, list_sort(list(kc)) AS kc FROM kcs GROUP BY 1)"


def prints(s: SparkSession, d: str) -> DataFrame:
    return similarity.fingerprints(table(s, d, "embeddings").select("vec_id", "embedding"), similarity.edges(s, N_KC, 64), HASH).drop("embedding")


@query("lsh1_edges", f"WITH {_EDGES}, m AS (SELECT d - 1 AS dim, AVG(CAST(embedding[d] AS DOUBLE)) AS mean FROM embeddings, (SELECT range AS d FROM range(1, 65)) GROUP BY 1) SELECT kc, dim, mean FROM edges JOIN m USING (dim)", "mean", "dim")
def _(s, d):
    """The inputs of each cell, with the mean of what the table's vectors put on them."""
    means = similarity.moments(table(s, d, "embeddings")).select("dim", "mean")
    return similarity.edges(s, N_KC, 64).join(F.broadcast(means), "dim")


@query("lsh2_normalised", f"WITH {_ACT} SELECT vec_id, SUM(z) AS total FROM z GROUP BY 1", "total")
def _(s, d):
    return similarity.normalised(table(s, d, "embeddings").select("vec_id", "embedding")).select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("lsh3_activations", f"WITH {_ACT} SELECT vec_id, kc, CAST(FLOOR(a * 10000 + 0.123456) AS BIGINT) AS a FROM act")
def _(s, d):
    v = similarity.normalised(table(s, d, "embeddings").select("vec_id", "embedding"))
    return similarity.activations(v, similarity.edges(s, N_KC, 64)).select("vec_id", F.posexplode("act").alias("kc", "a")).withColumn("a", F.floor(F.col("a") * 10000 + 0.123456))  # a cut that nine places can't hit


@query("lsh4_winners", f"WITH {_PRINTS} SELECT vec_id, array_to_string(list_transform(kc, lambda x: CAST(x AS VARCHAR)), ',') AS kc FROM prints")
def _(s, d):
    return prints(s, d).select("vec_id", F.array_join(F.transform("kc", lambda x: x.cast("string")), ",").alias("kc"))


_SIGN = "g AS (SELECT b.range AS bit, j.range AS dim, CASE WHEN left(md5('p' || b.range || '-' || j.range), 1) < '8' THEN 1.0 ELSE -1.0 END AS s FROM range(32) b, range(64) j), l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


@query("lsh5_sign_bits", f"WITH {_SIGN}, t AS (SELECT vec_id, bit, SUM(v * s) AS t FROM l JOIN g USING (dim) GROUP BY 1, 2) SELECT vec_id, COUNT(*) FILTER (t > 0) AS n, CAST(COALESCE(SUM(CASE WHEN t > 0 THEN bit END), 0) AS BIGINT) AS total FROM t GROUP BY 1")
def _(s, d):
    bits = similarity.sign_bits(table(s, d, "embeddings").select("vec_id", "embedding"), 32)
    return bits.select("vec_id", F.size("kc").alias("n"), F.aggregate("kc", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("lsh6_hamming", f"WITH {_PRINTS} SELECT vec_id, 2 * {HASH} - 2 * len(list_intersect(kc, (SELECT kc FROM prints WHERE vec_id = 0))) AS distance FROM prints", longs="distance")
def _(s, d):
    p = prints(s, d)
    return p.crossJoin(F.broadcast(p.where("vec_id = 0").select(F.col("kc").alias("q")))).select("vec_id", similarity.hamming("kc", "q").alias("distance"))


@query("jn11_pair_overlaps", f"WITH {_PRINTS} SELECT x.vec_id AS a, y.vec_id AS b, COUNT(*) AS shared FROM kcs x JOIN kcs y ON x.kc = y.kc AND x.vec_id < y.vec_id GROUP BY 1, 2")
def _(s, d):
    return similarity.pair_overlaps(prints(s, d), "vec_id")


@query("lsh7_normalised_hamming", f"WITH {_PRINTS} SELECT x.vec_id AS a, y.vec_id AS b, (2.0 * {HASH} - 2 * COUNT(*)) / (2 * {HASH}) AS distance FROM kcs x JOIN kcs y ON x.kc = y.kc AND x.vec_id < y.vec_id GROUP BY 1, 2", "distance")
def _(s, d):
    return similarity.pair_overlaps(prints(s, d), "vec_id").select("a", "b", (1 - F.col("shared") / HASH).alias("distance"))


_NEAR = f"{_PRINTS}, near AS (SELECT vec_id, 2 * {HASH} - 2 * len(list_intersect(kc, (SELECT kc FROM prints WHERE vec_id = 7))) AS distance FROM prints WHERE vec_id <> 7 ORDER BY 2, 1 LIMIT 15)"


@query("lsh8_more_like_this", f"WITH {_NEAR} SELECT * FROM near", longs="distance")
def _(s, d):
    return similarity.nearest(prints(s, d), "vec_id", 7, 15).select("vec_id", "distance")


@query("top9_nearest_ties", f"WITH {_PRINTS} SELECT vec_id, 2 * {HASH} - 2 * len(list_intersect(kc, (SELECT kc FROM prints WHERE vec_id = 7))) AS distance FROM prints JOIN embeddings USING (vec_id) WHERE vec_id <> 7 ORDER BY 2, label DESC, 1 LIMIT 15", longs="distance")
def _(s, d):
    tags = prints(s, d).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    return similarity.nearest(tags, "vec_id", 7, 15, F.desc("label")).select("vec_id", "distance")


@query("lsh9_tie_note", f"WITH {_NEAR} SELECT distance, COUNT(*) AS n FROM near GROUP BY 1 HAVING COUNT(*) > 1", longs="distance")
def _(s, d):
    return similarity.tie_note(similarity.nearest(prints(s, d), "vec_id", 7, 15))


@query("lsh11_average_precision", f"WITH {_PRINTS}, q AS (SELECT p.vec_id, e.label = (SELECT label FROM embeddings WHERE vec_id = 7) AS rel, 2 * {HASH} - 2 * len(list_intersect(kc, (SELECT kc FROM prints WHERE vec_id = 7))) AS distance FROM prints p JOIN embeddings e USING (vec_id) WHERE p.vec_id <> 7), r AS (SELECT rel, ROW_NUMBER() OVER (ORDER BY distance, vec_id) AS r, SUM(CAST(rel AS INTEGER)) OVER (ORDER BY distance, vec_id) AS h FROM q) SELECT 7 AS q, AVG(h / r) AS ap FROM r WHERE rel", "ap", "q")
def _(s, d):
    tags = prints(s, d).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    one = F.broadcast(tags.where("vec_id = 7").select(F.col("vec_id").alias("q"), F.col("kc").alias("qk"), F.col("label").alias("ql")))
    ranked = tags.where("vec_id <> 7").crossJoin(one).select("q", "vec_id", (F.col("label") == F.col("ql")).alias("rel"), similarity.hamming("kc", "qk").alias("distance"))
    return similarity.average_precision(ranked, "q", "rel", "distance", "vec_id")


@query("lsh13_unique_prints", f"WITH {_PRINTS} SELECT MIN(vec_id) AS rep, COUNT(*) AS n FROM prints GROUP BY kc")
def _(s, d):
    return prints(s, d).groupBy("kc").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).drop("kc")


_MATRIX = "inp AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey % 2 = 0), outp AS (SELECT s_suppkey AS id FROM supplier), w AS (SELECT o.id AS post, c.pre, c.weight FROM outp o LEFT JOIN (SELECT l_suppkey AS post, l_partkey AS pre, CAST(SUM(l_quantity) AS BIGINT) AS weight FROM lineitem WHERE l_partkey IN (SELECT id FROM inp) GROUP BY 1, 2) c ON c.post = o.id)"


def matrix(s: SparkSession, d: str) -> DataFrame:
    l = table(s, d, "lineitem")
    edges = l.select(F.col("l_suppkey").alias("post"), F.col("l_partkey").alias("pre"), F.col("l_quantity").cast("long").alias("weight"))
    return similarity.edge_matrix(edges, l.where("l_partkey % 2 = 0").select(F.col("l_partkey").alias("id")).distinct(), table(s, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("lsh14_edge_matrix", f"WITH {_MATRIX} SELECT post, pre, weight FROM w")
def _(s, d):
    return matrix(s, d)


@query("lsh15_connectivity", f"WITH {_MATRIX}, n AS (SELECT post, COUNT(pre) AS n FROM w GROUP BY 1) SELECT COUNT(*) AS n_post, AVG(n) AS mean_inputs, COUNT(*) FILTER (n = 0) AS isolated FROM n", "mean_inputs")
def _(s, d):
    return similarity.connectivity(matrix(s, d))


@query("lsh16_pool_inputs", f"WITH {_MATRIX} SELECT post, pre % 16 AS j, CAST(SUM(weight) AS BIGINT) AS weight FROM w WHERE pre IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return matrix(s, d).where("pre is not null").groupBy("post", (F.col("pre") % 16).alias("j")).agg(F.sum("weight").alias("weight"))


# --- taste ----------------------------------------------------------------------------------------------------------

_STEPS = f"{PLAYS}, ids AS (SELECT DISTINCT track_id FROM plays), tags AS (SELECT track_id, [(len(track_id) * 7 + ascii(track_id)) % 40, (ascii(track_id) * 3 + CAST(split_part(track_id, '-', 2) AS INTEGER)) % 40 + 40, CAST(split_part(track_id, '-', 1) AS INTEGER) % 40 + 80] AS kc FROM ids), steps AS (SELECT p.*, t.kc, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS step FROM plays p JOIN tags t USING (track_id))"


def taste_tags(own: DataFrame) -> DataFrame:
    """Three cells for each track, by a formula that SQL repeats."""
    t, part = F.col("track_id"), lambda i: F.split(F.col("track_id"), "-")[i].cast("int")
    cells = F.array((F.length(t) * 7 + F.ascii(t)) % 40, (F.ascii(t) * 3 + part(1)) % 40 + 40, part(0) % 40 + 80)
    return own.select("track_id").distinct().withColumn("kc", F.transform(cells, lambda x: x.cast("long")))


_WEIGHTS = f"""{_STEPS}, T AS (SELECT MAX(step) AS T FROM steps), e AS (SELECT unnest(kc) AS kc, step, CASE WHEN verdict > 0 THEN 'w_avoid' ELSE 'w_approach' END AS which FROM steps WHERE verdict <> 0),
    j AS (SELECT *, ROW_NUMBER() OVER w AS j, LEAD(step) OVER w AS nxt, MIN(step) OVER (PARTITION BY kc, which) AS first, COUNT(*) OVER (PARTITION BY kc, which) AS n FROM e WINDOW w AS (PARTITION BY kc, which ORDER BY step)),
    q AS (SELECT kc, which, SUM(pow(0.95, n - j) * (pow(0.99, T - COALESCE(nxt - 1, T)) - pow(0.99, T - step + 1))) + MAX(pow(0.95, n) * pow(0.99, T - first + 1)) AS w FROM j, T GROUP BY 1, 2),
    weights AS (SELECT kc, COALESCE(MAX(CASE WHEN which = 'w_approach' THEN w END), 1) AS w_approach, COALESCE(MAX(CASE WHEN which = 'w_avoid' THEN w END), 1) AS w_avoid FROM q GROUP BY 1)"""


def model(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = plays(s, d)
    tags = taste_tags(own)
    return tags, taste.weights(taste.steps(own, tags, ("ts", "event_id")))


@query("mb2_taste_weights", f"WITH {_WEIGHTS} SELECT * FROM weights", "w_approach w_avoid", "kc")
def _(s, d):
    return model(s, d)[1]


_VALENCE = f"{_WEIGHTS}, v AS (SELECT track_id, SUM(COALESCE(w_approach - w_avoid, 0)) AS valence FROM (SELECT track_id, unnest(kc) AS kc FROM tags) LEFT JOIN weights USING (kc) GROUP BY 1)"


@query("mb3_valence", f"WITH {_VALENCE} SELECT track_id, valence FROM v", "valence")
def _(s, d):
    tags, m = model(s, d)
    return taste.valence(tags, m, "track_id")


@query("mb4_score_rank", f"WITH {_VALENCE}, r AS (SELECT track_id, ROUND(valence, 6) AS v FROM v) SELECT track_id, RANK() OVER (ORDER BY v DESC) AS rank, CASE WHEN v > 0 THEN 'approach' WHEN v < 0 THEN 'avoid' ELSE 'neutral' END AS attitude FROM r")
def _(s, d):
    tags, m = model(s, d)
    v = taste.valence(tags, m, "track_id").withColumn("v", F.round("valence", 6))
    return ranks.min_rank(v, "v", "rank").select("track_id", "rank", taste.attitude("v").alias("attitude"))


@query("mb5_holdout", f"""WITH {_VALENCE.replace('JOIN tags t USING (track_id))', "JOIN tags t USING (track_id) WHERE ts < TIMESTAMP '2024-01-20')", 1)}, h AS (SELECT ROUND(-valence, 6) AS s, CAST(verdict < 0 AS INTEGER) AS y FROM plays JOIN v USING (track_id) WHERE ts >= TIMESTAMP '2024-01-20' AND verdict <> 0), r AS (SELECT y, RANK() OVER (ORDER BY s) + (COUNT(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM h)
    SELECT (SUM(CASE WHEN y = 1 THEN r ELSE 0 END) - SUM(y) * (SUM(y) + 1) / 2) / (SUM(y) * (COUNT(*) - SUM(y))) AS auc FROM r""", "auc")
def _(s, d):
    own = plays(s, d)
    tags, train = taste_tags(own), F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    v = taste.valence(tags, taste.weights(taste.steps(own.where(train), tags, ("ts", "event_id"))), "track_id")
    test = own.where(~train & (F.col("verdict") != 0)).join(v, "track_id").select(F.round(-F.col("valence"), 6).alias("s"), (F.col("verdict") < 0).cast("int").alias("y"))
    return evaluation.auc(test, "s", "y")


# --- resolution, labels, governance ---------------------------------------------------------------------------------


@query("str3_similarity")
def _(s, d):
    return titles(s, d).join(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", resolve.similarity("title", "p_name").alias("ratio"))


@query("str4_match_score")
def _(s, d):
    pair = titles(s, d).join(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey").withColumn("a", F.col("p_brand")).withColumn("b", F.col("p_brand"))
    return resolve.match_score(pair, "title", "a", "p_name", "b").select("p_partkey", "score")


@query("res1_resolve")
def _(s, d):
    wanted = titles(s, d).select(F.col("p_partkey").alias("q"), F.col("title").alias("q_title"), F.col("p_brand").alias("q_artist"))
    library = table(s, d, "part").select(F.col("p_partkey").alias("c"), F.col("p_name").alias("c_title"), F.col("p_brand").alias("c_artist"))
    return resolve.best(wanted, library).withColumn("status", resolve.status())


@query("res4_representative_albums", f"WITH {PLAYS} SELECT lower(artist_name) || '|' || lower(replace(album_name, ' (Remastered)', '')) AS album, MIN(track_id) AS track_id FROM plays WHERE verdict > 0 GROUP BY 1")
def _(s, d):
    """One liked track for each album, whose editions count together."""
    return plays(s, d).where("verdict > 0").groupBy(text.album_key("artist_name", "album_name").alias("album")).agg(F.min("track_id").alias("track_id"))


# events' objects in noise: before another one, within one that has braces and quotation marks in strings, none, unclosed, broken
_NOISY = """noisy AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Sure: ' || props || ' and {"another": ' WHEN 1 THEN 'x {"a": {"b": "}{\\" \\\\", "c": ' || props || '}} trailing }' WHEN 2 THEN 'no object'
    WHEN 3 THEN '{"open": ' || props WHEN 4 THEN 'y {bad: ' || props || '} {"k": 1}' ELSE '} { "t": [1, {"u": "' || event_type || '{"}] } "' END AS t FROM events)"""
_FOUND = f"""{_NOISY}, tok AS (SELECT event_id, substr(t, instr(t, '{{')) AS rest, instr(t, '{{') - 1 AS skipped, regexp_extract_all(regexp_replace(substr(t, instr(t, '{{')), '\\\\(.|\n)', '__', 'g'), '"[^"]*"|[{{}}]|[^"{{}}]+|"') AS l FROM noisy WHERE contains(t, '{{')),
    pos AS (SELECT event_id, rest, skipped, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM tok),
    run AS (SELECT *, SUM(CASE x WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth, SUM(len(x)) OVER w AS upto, COUNT(*) FILTER (x = '"') OVER w AS lone FROM pos WINDOW w AS (PARTITION BY event_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    ends AS (SELECT event_id, CAST(MIN(upto) AS BIGINT) AS n, ANY_VALUE(rest) AS rest, ANY_VALUE(skipped) AS skipped FROM run WHERE x = '}}' AND depth = 0 AND lone = 0 GROUP BY 1),
    found AS (SELECT event_id, CASE WHEN json_valid(left(rest, n)) THEN left(rest, n) END AS json, skipped + n AS stop FROM noisy LEFT JOIN ends USING (event_id))"""


def noisy(s: SparkSession, d: str) -> DataFrame:
    k, lit, p = F.col("event_id") % 6, F.lit, F.col("props")
    broken = F.concat(lit("y {bad: "), p, lit('} {"k": 1}'))
    nested = F.concat(lit('x {"a": {"b": "}{\\" \\\\", "c": '), p, lit("}} trailing }"))
    tail = F.concat(lit('} { "t": [1, {"u": "'), F.col("event_type"), lit('{"}] } "'))
    t = F.when(k == 0, F.concat(lit("Sure: "), p, lit(' and {"another": '))).when(k == 1, nested).when(k == 2, "no object").when(k == 3, F.concat(lit('{"open": '), p)).when(k == 4, broken).otherwise(tail)
    return table(s, d, "events").select("event_id", t.alias("t"))


@query("jsn1_first_object", f"WITH {_FOUND} SELECT event_id, json FROM found")
def _(s, d):
    return noisy(s, d).select("event_id", jsontext.first_object("t").alias("json"))


@query("jsn2_stop", f"WITH {_FOUND} SELECT event_id, stop FROM found", longs="stop")
def _(s, d):
    """Where a generator of each text could have stopped."""
    return noisy(s, d).select("event_id", jsontext.object_end("t").alias("stop"))


@query("jsn3_json_fields", "SELECT event_id, len(json_keys(props)) AS keys FROM events WHERE json_valid(props)", longs="keys")
def _(s, d):
    return table(s, d, "events").select("event_id", F.size(F.json_object_keys("props")).alias("keys")).where("keys >= 0")


@query("api3_payload", "SELECT conv_id, COUNT(*) AS items, MIN(role) AS first_role FROM conversations WHERE role IS NOT NULL GROUP BY 1")
def _(s, d):
    page = table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.struct("turn", "role").alias("track"))).alias("items"))).alias("payload"))
    item = page.select("conv_id", F.explode(F.from_json("payload", "items array<struct<track:struct<turn:long,role:string>>>")["items"]).alias("i")).where("i.track.role is not null")
    return item.groupBy("conv_id").agg(F.count("*").alias("items"), F.min("i.track.role").alias("first_role"))


# pages of an API in four shapes; every seventh is cut off
_ENTRY = "SELECT conv_id, turn, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CASE WHEN turn % 5 <> 4 THEN role || turn % 3 END AS id FROM conversations"


def pages(s: SparkSession, d: str) -> DataFrame:
    c, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    one = table(s, d, "conversations").select("conv_id", "turn", F.when(turn % 5 != 4, F.concat(role, (turn % 3).cast("string"))).alias("id"), role.alias("name"), F.concat(F.lit("A"), turn.cast("string")).alias("a"))
    entry = F.when(c % 4 == 0, F.to_json(F.struct(F.struct("id", "name", F.array(F.struct(F.col("a").alias("name"))).alias("artists")).alias("track"))))
    entry = entry.when(c % 4 == 1, F.to_json(F.struct(F.struct("id", "name", F.array("a").alias("artists")).alias("item")))).when(c % 4 == 2, F.to_json(F.struct("id", "name", F.col("a").alias("artist")))).otherwise(F.to_json(F.struct(F.struct("id", "name", F.struct(F.col("a").alias("name")).alias("artist")).alias("track"))))
    got = one.select("conv_id", "turn", entry.alias("e")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "e"))), lambda x: x["e"]), ",").alias("l"))
    body = F.when(c % 4 == 0, F.concat(F.lit('{"items":['), F.col("l"), F.lit("]}"))).when(c % 4 == 1, F.concat(F.lit('{"tracks":{"items":['), F.col("l"), F.lit("]}}"))).when(c % 4 == 2, F.concat(F.lit("["), F.col("l"), F.lit("]"))).otherwise(F.concat(F.lit('{"tracks":['), F.col("l"), F.lit("]}")))
    return got.select("conv_id", F.when(c % 7 == 0, F.left(body, F.length(body) - 1)).otherwise(body).alias("body"))


@query("api3_variant_tracks", f"WITH e AS ({_ENTRY}) SELECT conv_id, place, id, role AS name, 'A' || turn AS artist FROM e WHERE id IS NOT NULL AND conv_id % 7 <> 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY conv_id, id ORDER BY place) = 1")
def _(s, d):
    """The tracks of pages of any shape, read as VARIANT."""
    return payloads.tracks(payloads.parsed(pages(s, d), "body")[0], "conv_id")


@query("api3_malformed", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 0")
def _(s, d):
    return payloads.parsed(pages(s, d), "body")[1].select("conv_id")


@query("jsn3_variant_fields", "SELECT CASE conv_id % 4 WHEN 0 THEN 'items' ELSE 'tracks' END AS field, CASE conv_id % 4 WHEN 1 THEN 'OBJECT' ELSE 'ARRAY' END AS kind, COUNT(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 7 <> 0 AND conv_id % 4 <> 2 GROUP BY 1, 2")
def _(s, d):
    """The fields that pages have, with the kinds of their values."""
    return payloads.fields(payloads.parsed(pages(s, d), "body")[0])


@query("api5_validation", "SELECT COUNT(*) FILTER (NOT regexp_full_match(c_name, 'Customer#[0-9]+') OR len(c_name) NOT BETWEEN 1 AND 100) AS invalid FROM customer")
def _(s, d):
    bad = ~F.col("c_name").rlike("^Customer#[0-9]+$") | ~F.length("c_name").between(1, 100)
    return table(s, d, "customer").agg(F.count_if(bad).alias("invalid"))


@query("api6_daily_counter", "WITH c AS (SELECT event_id, CAST(ts AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) SELECT day, event_id FROM c WHERE n <= 20", dates="day")
def _(s, d):
    e = table(s, d, "events").withColumn("day", F.col("ts").cast("date"))
    return ranks.top_per(e, 20, ["day"], ["ts", "event_id"], "n").select("day", "event_id")


@query("ml1_group_split", "SELECT doc_id, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5('0|' || source), 1, 8) AS BIGINT) / 4294967296.0 AS p FROM documents)")
def _(s, d):
    return evaluation.split_groups(table(s, d, "documents").select("doc_id", "source"), "source").select("doc_id", "split")


@query("ml2_examples", "SELECT conv_id, turn, role || ': ' || text AS prompt FROM conversations WHERE turn = 0")
def _(s, d):
    return table(s, d, "conversations").where("turn = 0").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("prompt"))


@query("ml3_provenance", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'metadata' END AS arm, 'dry-run' AS label_source FROM documents")
def _(s, d):
    marks = table(s, d, "labels").select("doc_id").distinct().withColumn("m", F.lit("labelled"))
    return table(s, d, "documents").join(marks, "doc_id", "left").select("doc_id", F.coalesce("m", F.lit("metadata")).alias("arm"), F.lit("dry-run").alias("label_source"))


@query("ml4_parse_fallback", f"WITH {_FOUND} SELECT AVG(CAST(json IS NULL AS INTEGER)) AS failure_rate, COUNT(*) AS scored FROM found", "failure_rate")
def _(s, d):
    parsed = noisy(s, d).withColumn("json", jsontext.first_object("t"))
    return parsed.agg(F.avg(F.col("json").isNull().cast("int")).alias("failure_rate"), F.count("*").alias("scored"))


@query("ml6_text_status", "SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'unknown' WHEN trim(text) = '' THEN 'instrumental' ELSE 'found' END AS status FROM conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("text").isNull(), "unknown").when(F.trim("text") == "", "instrumental").otherwise("found").alias("status"))


@query("ml8_combined_ids", f"WITH {TRACKS} (SELECT track_id FROM tracks ORDER BY play_count DESC, track_id LIMIT 100) UNION ALL SELECT track_id FROM tracks WHERE track_id LIKE '1-%'")
def _(s, d):
    t = tracks(s, d)
    return ranks.top(t.select("track_id", "play_count"), 100, F.desc("play_count"), "track_id").select("track_id").union(t.where(F.col("track_id").like("1-%")).select("track_id"))


@query("res2_status_report", "SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN s_acctbal / 10000 >= 0.72 THEN 'matched' WHEN s_acctbal / 10000 >= 0.5 THEN 'best guess' ELSE 'missed' END AS status FROM supplier) GROUP BY 1")
def _(s, d):
    return table(s, d, "supplier").withColumn("score", F.col("s_acctbal") / 10000).groupBy(resolve.status().alias("status")).agg(F.count("*").alias("n"))


@query("gov1_coarse_violations", f"WITH {HOURLY} SELECT COUNT(*) AS n_rows, CAST(SUM(play_count) AS BIGINT) AS plays, 0 AS violations FROM hourly", longs="violations")
def _(s, d):
    hourly = warehouse.plays_hourly(plays(s, d))
    found = len(governance.coarse_violations({"plays_hourly": hourly}))
    return hourly.agg(F.count("*").alias("n_rows"), F.sum("play_count").alias("plays")).withColumn("violations", F.lit(found))


@query("gov3_personal_data", f"WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '{governance.EMAIL}')) AS emails, len(list_filter(regexp_extract_all(text, '{governance.QUAD}'), lambda q: NOT regexp_matches(q, '{governance.DOCUMENTATION}'))) AS addresses FROM documents) SELECT * FROM t WHERE emails > 0 OR addresses > 0", longs="emails addresses")
def _(s, d):
    return governance.personal_data(table(s, d, "documents"), "doc_id", "text")


_FILES = """files AS (SELECT CASE page_id % 10 WHEN 0 THEN 'data/' || page_id || '.html' WHEN 1 THEN 'web/public/rewind/' || page_id || '.json' WHEN 2 THEN 'web/app/' || page_id || '.tsx' WHEN 3 THEN 'src/' || page_id || '.MP3' WHEN 4 THEN 'docs/' || page_id || '/.env'
    WHEN 5 THEN 'web/public/rewind/' || page_id || '/index.json' WHEN 6 THEN 'export/Streaming_History_Audio_' || page_id || '.json' WHEN 7 THEN 'web/public/assets/' || page_id || '.json' WHEN 8 THEN 'notes/' || page_id || '.md' ELSE 'a' || page_id || '/.env.example' END AS path,
    CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN '{"audience": "synthetic", "privacy": "", "note": ' || page_id || '}' WHEN 2 THEN '{"ip_addr": "8.8.8.8", "audience":"private"}' ELSE '"refresh_token": "aaaaaaaaaaaaaaaaaaaaaaaa" America/Chicago "by_hour" "ip_addr": "192.0.2.7"' END AS text FROM pages)"""


def made_files(s: SparkSession, d: str) -> DataFrame:
    """Pages as files: ten kinds of path, four kinds of content."""
    k = F.col("page_id")
    n = k.cast("string")
    paths = [("data/", ".html"), ("web/public/rewind/", ".json"), ("web/app/", ".tsx"), ("src/", ".MP3"), ("docs/", "/.env"), ("web/public/rewind/", "/index.json"), ("export/Streaming_History_Audio_", ".json"), ("web/public/assets/", ".json"), ("notes/", ".md"), ("a", "/.env.example")]
    path = F.concat(F.element_at(F.array(*[F.lit(a) for a, _ in paths]), (k % 10 + 1).cast("int")), n, F.element_at(F.array(*[F.lit(b) for _, b in paths]), (k % 10 + 1).cast("int")))
    marked = F.concat(F.lit('{"audience": "synthetic", "privacy": "", "note": '), n, F.lit("}"))
    text = F.when(k % 4 == 0, F.col("html")).when(k % 4 == 1, marked).when(k % 4 == 2, '{"ip_addr": "8.8.8.8", "audience":"private"}').otherwise('"refresh_token": "aaaaaaaaaaaaaaaaaaaaaaaa" America/Chicago "by_hour" "ip_addr": "192.0.2.7"')
    return table(s, d, "pages").select(path.alias("path"), text.alias("text"))


@query("gov3_file_problems", f"""WITH {_FILES}, f AS (SELECT path, coalesce(text, '') AS t, CASE WHEN json_valid(text) THEN json_extract_string(text, '$.audience') END AS audience, coalesce(CASE WHEN json_valid(text) THEN json_extract_string(text, '$.privacy') END, '') AS privacy, split_part(path, '/', -1) AS name FROM files),
    p AS (SELECT path, unnest([CASE WHEN name = '.env.example' THEN NULL WHEN starts_with(path, 'data/') THEN 'derived from personal data' WHEN ends_with(lower(name), '.mp3') THEN 'audio or warehouse data' WHEN name = '.env' OR regexp_full_match(name, 'Streaming_History_.*[.]json') THEN 'raw export or secrets' END,
        CASE WHEN regexp_matches(t, '"refresh_token"\\s*:\\s*"[A-Za-z0-9_-]{{20,}}"') THEN 'refresh token' END, CASE WHEN contains(t, '"ip_addr": "8.8.8.8"') THEN 'ip_addr value' END, CASE WHEN regexp_matches(t, '"audience"\\s*:\\s*"private"') THEN 'private report' END,
        CASE WHEN regexp_matches(path, '^web/public/rewind/.*[.]json$') AND coalesce(audience, '') <> 'synthetic' THEN 'public report not marked synthetic' END, CASE WHEN starts_with(path, 'web/public/rewind/') AND audience = 'synthetic' AND ends_with(path, '/index.json') AND privacy = '' THEN 'no privacy note' END,
        CASE WHEN starts_with(path, 'web/public/') AND NOT regexp_matches(t, '"audience"\\s*:\\s*"synthetic"') AND contains(t, 'America/Chicago') AND contains(t, '"by_hour"') THEN 'hourly counts on a real clock' END]) AS problem FROM f) SELECT path, problem FROM p WHERE problem IS NOT NULL""")
def _(s, d):
    """What keeps each file from being published, by path, content and markers."""
    return governance.file_problems(made_files(s, d))


@query("rpt1_windows", "SELECT 'all' AS window_id, COUNT(*) AS plays FROM orders UNION ALL SELECT CAST(YEAR(o_orderdate) AS VARCHAR), COUNT(*) FROM orders GROUP BY 1")
def _(s, d):
    return warehouse.by_window(long_plays(s, d), "UTC").groupBy("window_id").agg(F.count("*").alias("plays"))


@query("rpt2_window_warehouse", f"WITH {ORDERS} SELECT CAST(YEAR(ts) AS VARCHAR) AS window_id, artist_name AS artist, COUNT(*) AS play_count, CAST(SUM(ms_played) AS BIGINT) AS total_ms FROM long_plays GROUP BY 1, 2 UNION ALL SELECT 'all', artist_name, COUNT(*), CAST(SUM(ms_played) AS BIGINT) FROM long_plays GROUP BY 2")
def _(s, d):
    return warehouse.by_window(long_plays(s, d), "UTC").groupBy("window_id", F.col("artist_name").alias("artist")).agg(F.count("*").alias("play_count"), F.sum("ms_played").alias("total_ms"))


@query("rpt11_hidden_gems", f"WITH {_VALENCE}, tr AS (SELECT track_id, MIN(artist_name) AS artist, COUNT(*) AS n, AVG(CASE WHEN reason_end = 'fwdbtn' THEN 1.0 ELSE 0.0 END) AS r FROM plays GROUP BY 1), g AS (SELECT tr.track_id, tr.artist, ROUND(valence, 6) AS score FROM tr JOIN v USING (track_id) WHERE n BETWEEN 1 AND 5 AND r = 0), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY artist ORDER BY score DESC, track_id) AS k FROM g) SELECT track_id, artist, score FROM o WHERE k = 1 ORDER BY score DESC, track_id LIMIT 5", "score")
def _(s, d):
    tags, m = model(s, d)
    v = taste.valence(tags, m, "track_id")
    g = tracks(s, d).join(v, "track_id").where(F.col("play_count").between(1, 5) & (F.col("skip_rate") == 0)).select("track_id", "artist", F.round("valence", 6).alias("score"))
    return ranks.top(ranks.keep_one(g, ["artist"], [F.desc("score"), "track_id"]), 5, F.desc("score"), "track_id")


@query("vis4_seeds", f"WITH {TRACKS} SELECT track_id, play_count FROM tracks WHERE skip_rate < 0.5 ORDER BY play_count DESC, track_id LIMIT 5")
def _(s, d):
    return ranks.top(tracks(s, d).where("skip_rate < 0.5").select("track_id", "play_count"), 5, F.desc("play_count"), "track_id")


@query("vis1_rerank", f"WITH {_NEAR}, c AS (SELECT near.*, label FROM near JOIN embeddings USING (vec_id)) SELECT arg_max(vec_id, (label, -distance, -vec_id)) AS winner, COUNT(*) FILTER (distance < (SELECT arg_max(distance, (label, -distance, -vec_id)) FROM c)) AS closer_losers FROM c")
def _(s, d):
    near = similarity.nearest(prints(s, d), "vec_id", 7, 15).select("vec_id", "distance").join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    best = near.agg(F.max_by(F.struct("vec_id", "distance"), F.struct("label", -F.col("distance"), -F.col("vec_id"))).alias("w"))
    return near.crossJoin(F.broadcast(best)).agg(F.max("w.vec_id").alias("winner"), F.count_if(F.col("distance") < F.col("w.distance")).alias("closer_losers"))
