"""Queries: reachability of modules, neighbours by an inverted index, kNN by pivots, misspelt titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours, reach, resolve, similarity
from ..sources.adapters import table
from ..sources.stored import written
from .queries_models import _ACT, _PRINTS, _SIGN, HASH, prints
from .registry import query

# --- modules: parts are modules of a package for each brand; an order's returned line imports the line after it, and a package
# --- its cheapest part

_MODULES = """named AS (SELECT p_partkey, p_size, p_retailprice, 'lib.b' || substr(p_brand, 7) AS package, 'lib.b' || substr(p_brand, 7) || '.p' || p_partkey AS module FROM part),
    modules AS (SELECT module FROM named UNION SELECT package FROM named),
    lines AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_returnflag = 'R' AND a.l_quantity > 40),
    imports AS (SELECT s.module AS src, t.module AS dst FROM lines JOIN named s ON s.p_partkey = src JOIN named t ON t.p_partkey = dst
        UNION SELECT package, arg_min(module, (p_retailprice, p_partkey)) FROM named GROUP BY 1),
    edges AS (SELECT src, dst FROM imports WHERE src <> dst
        UNION SELECT src, regexp_extract(dst, '^[^.]+[.][^.]+') AS p FROM imports WHERE regexp_extract(dst, '^[^.]+[.][^.]+') IN (SELECT module FROM modules) AND src <> p)"""


def named(s: SparkSession, d: str) -> DataFrame:
    package = F.concat(F.lit("lib.b"), F.expr("substring(p_brand, 7)"))
    return table(s, d, "part").select("p_partkey", "p_size", "p_retailprice", package.alias("package"), F.concat(package, F.lit(".p"), F.col("p_partkey").cast("string")).alias("module"))


def imports(s: SparkSession, d: str) -> DataFrame:
    own = named(s, d)
    line = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    first = line.where("l_returnflag = 'R' and l_quantity > 40").select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("a"))
    pairs = first.join(line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("b")), ["l_orderkey", "l_linenumber"]).select("a", "b").distinct()
    named_as = lambda key, name: own.select(F.col("p_partkey").alias(key), F.col("module").alias(name))
    edges = pairs.join(named_as("a", "src"), "a").join(named_as("b", "dst"), "b").select("src", "dst")
    return edges.unionByName(own.groupBy(F.col("package").alias("src")).agg(F.min_by("module", F.struct("p_retailprice", "p_partkey")).alias("dst")))


def module_graph(s: SparkSession, d: str) -> DataFrame:
    own = named(s, d)
    return reach.with_packages(imports(s, d), own.select("module").unionByName(own.select(F.col("package").alias("module"))))


@query("gov4_reachability", f"WITH RECURSIVE {_MODULES}, r AS (SELECT module AS start, module FROM named WHERE p_size = 50 UNION SELECT start, dst FROM r JOIN edges ON src = module) SELECT start, module FROM r")
def _(s, d):
    """All modules that the largest parts' modules reach, through any number of imports."""
    starts = named(s, d).where("p_size = 50").select(F.col("module").alias("start"))
    return reach.reached(written(module_graph(s, d)), starts).select("start", "module")


@query("gov4_import_chain", f"""WITH RECURSIVE {_MODULES}, r AS (SELECT min(package) AS module, 0 AS hops FROM named UNION SELECT dst, hops + 1 FROM r JOIN edges ON src = module WHERE hops < 60),
    h AS (SELECT module, MIN(hops) AS hops FROM r GROUP BY 1) SELECT h.module, h.hops, (SELECT MIN(src) FROM edges JOIN h g ON g.module = src AND g.hops + 1 = h.hops WHERE dst = h.module) AS via FROM h""", longs="hops")
def _(s, d):
    """From one package: shortest ways, and the module that each module is first imported by."""
    start = named(s, d).agg(F.min("package").alias("start"))
    return reach.reachable(module_graph(s, d), start).select("module", "hops", "via")


@query("gov4_violations", f"""WITH RECURSIVE {_MODULES}, r AS (SELECT module AS start, module FROM named WHERE p_size = 50 UNION SELECT start, dst FROM r JOIN edges ON src = module)
    SELECT r.module, COUNT(*) AS n FROM r JOIN named n ON n.module = r.module WHERE p_size = 1 AND r.start <> r.module GROUP BY 1""")
def _(s, d):
    """How many of the largest parts' modules reach each of the smallest parts', which none of them should."""
    own = named(s, d)
    reached = reach.reached(written(module_graph(s, d)), own.where("p_size = 50").select(F.col("module").alias("start")))
    return reach.violations(reached, own.where("p_size = 1")).groupBy("module").agg(F.count("*").alias("n"))


# --- neighbours of a stated query set (ids divisible by 20) among all rows -------------------------------------------

_ASKED = "vec_id % 20 = 0"
_PAIRS = f"{_PRINTS}, pairs AS (SELECT q.vec_id AS q, p.vec_id, 2 * {HASH} - 2 * len(list_intersect(p.kc, q.kc)) AS distance FROM prints p JOIN prints q ON q.{_ASKED} AND p.vec_id <> q.vec_id)"


@query("lsh8_neighbour_table", f"WITH {_PAIRS} SELECT q, vec_id, distance, ROW_NUMBER() OVER (PARTITION BY q ORDER BY distance, vec_id) AS place FROM pairs QUALIFY place <= 15", longs="distance")
def _(s, d):
    own = prints(s, d)
    return neighbours.nearest_sets(own, own.where(_ASKED), "vec_id", 15)


@query("top9_neighbour_table", f"WITH {_PAIRS} SELECT q, vec_id, label, distance, ROW_NUMBER() OVER (PARTITION BY q ORDER BY distance, label DESC, vec_id) AS place FROM pairs JOIN embeddings USING (vec_id) QUALIFY place <= 10", longs="distance label")
def _(s, d):
    own = prints(s, d).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    return neighbours.nearest_sets(own, own.where(_ASKED), "vec_id", 10, ties=(F.desc("label"),), extra=("label",))


@query("lsh8_sign_neighbours", f"""WITH {_SIGN}, t AS (SELECT vec_id, bit, SUM(v * s) AS t FROM l JOIN g USING (dim) GROUP BY 1, 2), b AS (SELECT vec_id, list(bit) FILTER (t > 0) AS kc FROM t GROUP BY 1), p AS (SELECT vec_id, coalesce(kc, []) AS kc FROM b),
    pairs AS (SELECT q.vec_id AS q, p.vec_id, len(p.kc) + len(q.kc) - 2 * len(list_intersect(p.kc, q.kc)) AS distance FROM p JOIN p q ON q.{_ASKED} AND p.vec_id <> q.vec_id)
    SELECT q, vec_id, distance, ROW_NUMBER() OVER (PARTITION BY q ORDER BY distance, vec_id) AS place FROM pairs QUALIFY place <= 10""", longs="distance")
def _(s, d):
    """Sets of different sizes: the bits of a sign projection."""
    own = similarity.sign_bits(table(s, d, "embeddings").select("vec_id", "embedding"), 32).select("vec_id", "kc")
    return neighbours.nearest_sets(own, own.where(_ASKED), "vec_id", 10)


_KNN = "near AS (SELECT q.vec_id AS q, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM embeddings e JOIN embeddings q ON e.vec_id <> q.vec_id QUALIFY ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) <= 10)"


@query("lsh10_knn_table", f"WITH {_KNN} SELECT q, vec_id, distance, ROW_NUMBER() OVER (PARTITION BY q ORDER BY distance, vec_id) AS place FROM near", "distance")
def _(s, d):
    """Of every row, not of a query set."""
    own = table(s, d, "embeddings").select("vec_id", "embedding")
    return neighbours.knn(own, own, "vec_id", 10)


_TRUTH = f"asked AS (SELECT vec_id FROM embeddings WHERE {_ASKED} ORDER BY 1 LIMIT 100), truth AS (SELECT q.vec_id AS q, e.vec_id FROM embeddings e JOIN embeddings q ON q.vec_id IN (SELECT vec_id FROM asked) AND e.vec_id <> q.vec_id QUALIFY ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) <= 10)"


@query("lsh12_benchmark_sweep", f"""WITH {_ACT}, {_SIGN.split(', l AS')[0]}, {_TRUTH}, ranked AS (SELECT vec_id, kc, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY a DESC, kc) AS r FROM act),
    bits AS (SELECT vec_id, bit FROM l JOIN g USING (dim) WHERE bit < 16 GROUP BY 1, 2 HAVING SUM(v * s) > 0),
    sets AS (SELECT 'wta_4' AS hash, vec_id, list(kc) AS kc FROM ranked WHERE r <= 4 GROUP BY 2 UNION ALL SELECT 'wta_12', vec_id, list(kc) FROM ranked WHERE r <= 12 GROUP BY 2
        UNION ALL SELECT 'sign_16', e.vec_id, coalesce(list(bit) FILTER (bit IS NOT NULL), []) FROM embeddings e LEFT JOIN bits USING (vec_id) GROUP BY 2),
    d AS (SELECT p.hash, q.vec_id AS q, p.vec_id, len(p.kc) + len(q.kc) - 2 * len(list_intersect(p.kc, q.kc)) AS distance FROM sets p JOIN sets q ON p.hash = q.hash AND q.vec_id IN (SELECT vec_id FROM asked) AND p.vec_id <> q.vec_id),
    o AS (SELECT *, (q, vec_id) IN (SELECT (q, vec_id) FROM truth) AS hit, ROW_NUMBER() OVER (PARTITION BY hash, q ORDER BY distance, vec_id) AS r FROM d),
    h AS (SELECT hash, q, r, ROW_NUMBER() OVER (PARTITION BY hash, q ORDER BY r) AS i FROM o WHERE hit), ap AS (SELECT hash, q, AVG(i / r) AS ap FROM h GROUP BY 1, 2)
    SELECT hash, AVG(ap) AS map FROM ap GROUP BY 1""", "map")
def _(s, d):
    """How well hashes of several lengths find the ten true neighbours of the first hundred ids divisible by 20, among all rows."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    truth = written(neighbours.knn(v, v.where(_ASKED).orderBy("vec_id").limit(100), "vec_id", 10).select("q", "vec_id"))
    act = similarity.activations(similarity.normalised(v), similarity.edges(s, 120, 64))
    hashes = [(f"wta_{k}", similarity.winners(act, k)) for k in (4, 12)] + [("sign_16", similarity.sign_bits(v, 16))]
    rows = [neighbours.precision_of_truth(own, truth, "vec_id", 10).agg(F.avg("ap").alias("map")).select(F.lit(name).alias("hash"), "map") for name, own in hashes]
    return reduce(DataFrame.unionByName, rows)


# --- misspelt titles: a letter left out, one twice, or two in the wrong order, by key --------------------------------

_WRONG = "CASE p_partkey % 3 WHEN 0 THEN left(p_name, 2) || substr(p_name, 4) WHEN 1 THEN left(p_name, 2) || substr(p_name, 2) ELSE left(p_name, 3) || substr(p_name, 5, 1) || substr(p_name, 4, 1) || substr(p_name, 6) END"


def misspelt(s: SparkSession, d: str) -> DataFrame:
    part = lambda start, n=100: F.substring("p_name", start, n)
    k = F.col("p_partkey") % 3
    wrong = F.when(k == 0, F.concat(part(1, 2), part(4))).when(k == 1, F.concat(part(1, 2), part(2))).otherwise(F.concat(part(1, 3), part(5, 1), part(4, 1), part(6)))
    return table(s, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_brand").alias("q_artist"), wrong.alias("q_title"))


def library(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("c"), F.col("p_name").alias("c_title"), F.col("p_brand").alias("c_artist"))


def _bag(x: str, width: int) -> str:
    """The numbered substrings of a text in SQL: pairs between marks, or characters."""
    marked = f"(chr(2) || {x} || chr(3))" if width == 2 else x
    grams = f"list_transform(range(1, len({marked}) + {2 - width}), lambda i: substr({marked}, i, {width}))"
    return f"list_transform({grams}, lambda g, i: g || len(list_filter({grams}[:i], lambda y: y = g)))"


@query("jn12_misspelt_candidates", f"""WITH q AS (SELECT DISTINCT {_WRONG} AS a FROM part), c AS (SELECT DISTINCT p_name AS b FROM part),
    g AS (SELECT a, {_bag('a', 2)} AS ga, {_bag('a', 1)} AS la FROM q), h AS (SELECT b, {_bag('b', 2)} AS gb, {_bag('b', 1)} AS lb FROM c),
    p AS (SELECT a, b, len(list_intersect(ga, gb)) AS grams, len(list_intersect(la, lb)) AS letters, ceil(round((len(a) + len(b)) * 0.72 / 2, 9)) AS m FROM g, h WHERE least(len(a), len(b)) >= greatest(len(a), len(b)) * 0.72 / 1.28 - 1e-9)
    SELECT a AS title, COUNT(*) AS candidates FROM p WHERE grams >= greatest(1, 3 * m + 1 - len(a) - len(b)) AND letters >= m GROUP BY 1""")
def _(s, d):
    """Of each misspelt title the number of library titles that may be similar enough."""
    asked = misspelt(s, d).withColumnRenamed("q_title", "title")
    return resolve.similar_pairs(asked, "title", library(s, d), "c_title").groupBy("title").agg(F.count("*").alias("candidates"))


@query("res1_misspelt")
def _(s, d):
    """The library's row for each misspelt title."""
    return resolve.best(misspelt(s, d), library(s, d), resolve.block_misspelt).withColumn("status", resolve.status())
