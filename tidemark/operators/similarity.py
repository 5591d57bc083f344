"""Sparse binary fingerprints: random sparse projection, winner-take-all, Hamming distance, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks


def edges(spark: SparkSession, n_kc: int, dims: int, sample: int = 6) -> DataFrame:
    """(kc, dim): the inputs of each output cell, by a rule that any engine can repeat. Its size is the caller's choice."""
    grid = spark.range(n_kc).select(F.col("id").alias("kc")).crossJoin(spark.range(dims).select(F.col("id").alias("dim")))
    order = F.md5(F.concat(F.col("kc").cast("string"), F.lit("-"), F.col("dim").cast("string")))
    return grid.withColumn("k", F.row_number().over(Window.partitionBy("kc").orderBy(order))).where(F.col("k") <= min(sample, dims)).drop("k")


def moments(vectors: DataFrame, x: str = "embedding") -> DataFrame:
    """Mean and population deviation (0 counts as 1) of each dimension."""
    long = vectors.select(F.posexplode(x).alias("dim", "v"))
    return long.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def _field(name: str):
    return lambda s: s[name]


def _lists(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row with the columns as arrays in the order of `key`; for small tables that are broadcast."""
    packed = F.array_sort(F.collect_list(F.struct(key, *cols)))
    return df.agg(*[F.transform(packed, _field(c)).alias(c) for c in cols])


def normalised(vectors: DataFrame, x: str = "embedding") -> DataFrame:
    """z-scores, cut at 0. The moments (one row) are broadcast."""
    m = F.broadcast(_lists(moments(vectors, x), "dim", "mean", "sd"))
    z = F.transform(x, lambda v, i: F.greatest(F.lit(0.0), (v.cast("double") - F.col("mean")[i]) / F.col("sd")[i]))
    return vectors.crossJoin(m).withColumn(x, z).drop("mean", "sd")


def activations(vectors: DataFrame, edge: DataFrame, x: str = "embedding") -> DataFrame:
    """Adds `act`: each cell's sum of its inputs. Edges are packed into one broadcast row, so vectors aren't shuffled."""
    packed = edge.groupBy("kc").agg(F.array_sort(F.collect_list("dim")).alias("dims"))
    cells = F.broadcast(_lists(packed, "kc", "dims"))
    act = F.transform("dims", lambda ds: F.round(F.aggregate(ds, F.lit(0.0), lambda a, i: a + F.col(x)[i.cast("int")]), 9))
    return vectors.crossJoin(cells).withColumn("act", act).drop("dims")


def winners(df: DataFrame, k: int) -> DataFrame:
    """Adds `kc`, the k most active cells in ascending order; of equal ones the lower."""
    ranked = F.slice(F.array_sort(F.transform("act", lambda a, i: F.struct((-a).alias("a"), i.cast("long").alias("i")))), 1, k)
    return df.withColumn("kc", F.array_sort(F.transform(ranked, lambda s: s["i"]))).drop("act")


def fingerprints(vectors: DataFrame, edge: DataFrame, k: int, x: str = "embedding") -> DataFrame:
    return winners(activations(normalised(vectors, x), edge, x), k)


def hamming(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def pair_overlaps(tags: DataFrame, key: str) -> DataFrame:
    """(a, b, shared) for pairs that share a cell, counted block by block: no row is sent for a pair or a shared cell."""
    return blocks.overlaps(tags, key)


def nearest(tags: DataFrame, key: str, query, n: int, *ties: Column) -> DataFrame:
    """The n rows nearest to one fingerprint; ties in distance by `ties`, then key. The query is one broadcast row."""
    one = F.broadcast(tags.where(F.col(key) == query).select(F.col("kc").alias("q")).limit(1))
    got = tags.where(F.col(key) != query).crossJoin(one).withColumn("distance", hamming("kc", "q").cast("long"))
    return got.orderBy("distance", *ties, key).limit(n)


def tie_note(near: DataFrame) -> DataFrame:
    """Number of rows at each distance that occurs more than once."""
    return near.groupBy("distance").agg(F.count("*").alias("n")).where("n > 1")


def sign_bits(vectors: DataFrame, bits: int, x: str = "embedding") -> DataFrame:
    """Classical sign projection onto +-1 planes that a hash rule defines: the set bits, ascending."""
    dims = vectors.select(F.size(x)).first()[0]
    spark = vectors.sparkSession
    grid = spark.range(bits).select(F.col("id").alias("bit")).crossJoin(spark.range(dims).select(F.col("id").alias("dim")))
    sign = F.when(F.substring(F.md5(F.concat(F.lit("p"), F.col("bit").cast("string"), F.lit("-"), F.col("dim").cast("string"))), 1, 1) < "8", 1.0).otherwise(-1.0)
    planes = grid.groupBy("bit").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", sign.alias("s")))), lambda t: t["s"]).alias("plane"))
    packed = F.broadcast(_lists(planes, "bit", "plane"))
    dot = lambda p: F.aggregate(F.zip_with(p, x, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda a, v: a + v)
    hits = F.filter(F.transform("plane", lambda p, i: F.when(dot(p) > 0, i.cast("long"))), lambda v: v.isNotNull())
    return vectors.crossJoin(packed).withColumn("kc", hits).drop("plane")


def average_precision(ranked: DataFrame, query: str, relevant: str, *order) -> DataFrame:
    """Per query: mean over its relevant rows of the precision at their rank."""
    w = Window.partitionBy(query).orderBy(*order)
    r = ranked.withColumn("r", F.row_number().over(w)).withColumn("h", F.sum(F.col(relevant).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.where(relevant).groupBy(query).agg(F.avg(F.col("h") / F.col("r")).alias("ap"))


def edge_matrix(connections: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(post, pre, weight) of edges from inputs to outputs, parallel ones added; outputs without any have a null pre."""
    own = connections.join(F.broadcast(inputs.select(F.col("id").alias("pre"))), "pre", "left_semi").join(outputs.select(F.col("id").alias("post")), "post", "left_semi")
    return outputs.select(F.col("id").alias("post")).join(own.groupBy("post", "pre").agg(F.sum("weight").alias("weight")), "post", "left")


def connectivity(matrix: DataFrame) -> DataFrame:
    per = matrix.groupBy("post").agg(F.count("pre").alias("n"))
    return per.agg(F.count("*").alias("n_post"), F.avg("n").alias("mean_inputs"), F.count_if(F.col("n") == 0).alias("isolated"))


def pooled(vectors: DataFrame, width: int, x: str = "embedding") -> DataFrame:
    """Dimensions added up modulo `width`."""
    add = lambda j: F.aggregate(F.filter(x, lambda v, i: i % width == j), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return vectors.withColumn(x, F.array(*[add(j) for j in range(width)]))


def find(tracks: DataFrame, key: str, name: str, plays: str, asked: str) -> DataFrame:
    """At most one row: the track of this key, else of those whose name holds the text (in either case) the one played most."""
    exact = F.col(key).cast("string") == asked
    own = tracks.where(exact | F.contains(F.lower(name), F.lit(asked.lower())))
    return own.orderBy(exact.desc(), F.desc_nulls_last(plays), key).limit(1)


def more_like_this(tracks: DataFrame, key: str, asked: str, n: int, valence: str = "valence", plays: str = "plays", name: str = "name") -> DataFrame:
    """The n nearest to the track that a key or a part of a name means: with `distance`, and `tied`, how many of all tracks are
    as near. Equally near ones come by valence, then plays, then key. No rows if nothing matches."""
    one = F.broadcast(find(tracks, key, name, plays, asked).select(F.col(key).alias("_key"), F.col("kc").alias("_kc")))
    far = tracks.crossJoin(one).where(F.col(key) != F.col("_key")).withColumn("distance", hamming("kc", "_kc").cast("long")).drop("_key", "_kc")
    near = far.orderBy("distance", F.desc_nulls_last(valence), F.desc_nulls_last(plays), key).limit(n)
    return near.join(F.broadcast(far.groupBy("distance").agg(F.count("*").alias("tied"))), "distance")  # a row for each distance
