"""Embedding near-duplicates by product quantisation: coarse inverted lists hold residual subspace codes, queries score
lists by table look-up, and what may reach the threshold is ranked again by exact cosine in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components, materialise

THRESHOLD = 0.93
#: Vectors that the index is fitted on, at most.
SAMPLE = 8192
#: Coarse lists: twice the square root of the vectors of a label, within these bounds.
LISTS = (16, 4096)
#: Lists searched for each vector.
PROBES = 10
SUBSPACES, CODES = 8, 64
#: Vectors in one block of an inverted list, and queries that are put to it together.
BLOCK, ASKED = 1024, 8192
_K = ["k1", "k2"]


@dataclass
class Index:
    coarse: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x codes x (dim / subspaces)
    slack: float  # what approximate cosines may miss

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = (x - self.coarse[lists]).reshape(len(x), len(self.books), -1)
        return np.stack([((b**2).sum(1)[None] - 2 * r[:, s] @ b.T).argmin(1) for s, b in enumerate(self.books)], 1).astype(np.uint8)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists whose centres are nearest, nearest first."""
        d = (self.coarse**2).sum(1)[None] - 2 * x @ self.coarse.T
        n = min(n, d.shape[1])
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1), 1)

    def look_up(self, q: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """Approximate cosines of queries with the coded vectors of one list."""
        out = np.repeat((q @ self.coarse[which])[:, None], len(codes), 1)
        parts = q.reshape(len(q), len(self.books), -1)
        for s, b in enumerate(self.books):
            out += (parts[:, s] @ b.T)[:, codes[:, s]]
        return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fit(x: np.ndarray, lists: int, seed: int = 7) -> Index:
    """Fit on unit vectors; the number of subspaces is the largest up to SUBSPACES that divides the dimension."""
    rng = np.random.default_rng(seed)
    coarse = k_means(x, lists, rng)
    near = ((coarse**2).sum(1)[None] - 2 * x @ coarse.T).argmin(1)
    m = next(s for s in range(SUBSPACES, 0, -1) if x.shape[1] % s == 0)
    r = (x - coarse[near]).reshape(len(x), m, -1)
    books = [k_means(r[:, s], CODES, rng) for s in range(m)]
    index = Index(coarse, np.stack(books), 0.0)
    codes = index.codes(x, near)
    rebuilt = coarse[near] + np.concatenate([b[codes[:, s]] for s, b in enumerate(index.books)], 1)
    # |q.(x - rebuilt)| <= |x - rebuilt| for unit q; for a q near x it is nearly the error along x
    along = np.abs(((x - rebuilt) * x).sum(1))
    index.slack = float(np.quantile(along, 0.999) + 0.4 * np.quantile(np.linalg.norm(x - rebuilt, axis=1), 0.999))
    return index


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows with their class key or null keys, one row for each class: k1, k2, rep, least, label, embedding, n).

    A class is the rows of one label with the same vector; `rep` is a number of its own, which must be written before it is
    used, and `least` its smallest vec_id (null: all of its rows have none). Vectors that can't link have null keys. Keys are
    two 64-bit hashes; counts are combined before the shuffle, so a vector that a third of all rows share is no bottleneck.
    """
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    e = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("ok", F.coalesce(good, F.lit(False)))
    key = lambda seed: F.when(F.col("ok"), F.xxhash64(F.lit(seed), "label", e))
    rows = rows.withColumn("k1", key(1)).withColumn("k2", key(2))
    one = rows.where("ok").groupBy(*_K).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    return rows.select("vec_id", *_K), one.withColumn("rep", F.monotonically_increasing_id())


_FOUND = "a long, b long, n long"


def links(one: DataFrame, scratch: Scratch) -> DataFrame:
    """What each block of an inverted list finds, without its pairs: a spanning forest of the links between class
    representatives (a, b, 0), and how many rows each is linked with (a, a, n), each link being counted in one block.
    `one` can be read again."""
    spark = one.sparkSession
    shape = one.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()
    pairs = None
    for r in sorted(shape, key=lambda r: r["dim"]):  # as a rule one dimension
        found = _links_of(spark, one.where(F.size("embedding") == r["dim"]), r["n"], scratch)
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs if pairs is not None else spark.createDataFrame([], _FOUND)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links_of(spark, one: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    sample = one.orderBy(*_K).limit(SAMPLE).select("embedding").toPandas()
    lists = int(min(LISTS[1], max(LISTS[0], 2 * most**0.5), len(sample)))
    shared = spark.sparkContext.broadcast(fit(_unit(sample["embedding"]), lists))

    def assign(frames):
        index = shared.value
        for f in frames:
            if len(f):
                x = _unit(f["embedding"]).astype(np.float32)
                probes = index.nearest(x, PROBES)
                yield f.assign(probes=list(probes.astype(np.int32)), code=[c.tobytes() for c in index.codes(x, probes[:, 0])])

    # vectors keep the type they came in: half the bytes of doubles, as a rule
    kind = one.schema["embedding"].dataType.simpleString()
    placed = scratch.keep(one.select("rep", "n", "label", "embedding").mapInPandas(assign, f"rep long, n long, label int, embedding {kind}, probes array<int>, code binary"), "lists")
    # blocks of each list and shares of its queries: at most labels x lists rows. A group holds one of each, so its size is
    # bounded, and a pair meets in one group
    probes = placed.select("label", F.posexplode("probes").alias("nth", "list"))
    size = probes.groupBy("label", "list").agg(F.ceil(F.count_if(F.col("nth") == 0) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / ASKED).cast("int").alias("shares"))
    size = size.where("blocks > 0")
    row = ["rep", "n", "embedding", "probes", "code"]
    own = placed.select("label", *row, F.col("probes")[0].alias("list")).join(size, ["label", "list"])
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = own.select("label", "list", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), span("shares").alias("share"), F.lit(True).alias("base"), *row)
    asked = placed.withColumn("code", F.lit(None).cast("binary")).select("label", *row, F.explode("probes").alias("list")).join(size, ["label", "list"])
    query = asked.select("label", "list", span("blocks").alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shares")).cast("int").alias("share"), F.lit(False).alias("base"), *row)

    def search(key, f: pd.DataFrame) -> pd.DataFrame:
        index, which = shared.value, int(key[1])
        b, q = f[f["base"]], f[~f["base"]]
        if not len(b) or not len(q):
            return pd.DataFrame(columns=["a", "b", "n"], dtype=np.int64)
        xb, ib, nb, pb = _unit(b["embedding"]), b["rep"].to_numpy(), b["n"].to_numpy(), np.stack(b["probes"].to_numpy())
        codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
        counts: dict[int, int] = {}
        up: dict[int, int] = {}
        edges = []

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for at in range(0, len(q), 2048):
            part = q.iloc[at : at + 2048]
            xq, iq, nq, own_list = _unit(part["embedding"]), part["rep"].to_numpy(), part["n"].to_numpy(), np.array([p[0] for p in part["probes"]])
            i, j = np.nonzero(index.look_up(xq, codes, which) >= THRESHOLD - index.slack)
            ok = iq[i] != ib[j]
            i, j = i[ok], j[ok]
            ok = np.einsum("nd,nd->n", xq[i], xb[j]) >= THRESHOLD
            i, j = i[ok], j[ok]
            # a query counts what it finds; what it finds counts it in turn, unless that finds the query by itself
            silent = ~(pb[j] == own_list[i][:, None]).any(1)
            for ids, n in ((iq, np.bincount(i, nb[j], len(iq))), (ib, np.bincount(j[silent], nq[i[silent]], len(ib)))):
                for k in np.flatnonzero(n):
                    counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(n[k])
            for x, y in zip(iq[i].tolist(), ib[j].tolist()):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    edges.append((max(x, y), min(x, y), 0))
        return pd.DataFrame(edges + [(k, k, n) for k, n in counts.items()], columns=["a", "b", "n"], dtype=np.int64)

    return base.unionByName(query).groupBy("label", "list", "block", "share").applyInPandas(search, _FOUND)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row (vec_id, embedding, label).

    Links join rows of one label whose cosine is at least 0.93. Null labels and vectors that are null, empty, zero or hold
    null or non-finite numbers link with nothing. Vectors of different dimensions aren't compared. Copies are one class:
    they link with each other and share the links of their class.

    Rows are told apart by their vectors, never by vec_id: rows that repeat a vec_id count as rows of their own, with the
    links of their own vector, and so do rows without one. component_id is the smallest vec_id of the rows in reach, nulls
    aside; it is null where none has one. kept is vec_id = component_id, two nulls being equal, so all rows with the smallest
    vec_id are kept.
    """
    rows, one = classes(vectors)
    scratch = Scratch()
    one = scratch.keep(one, "classes")
    found = scratch.keep(links(one, scratch), "links")
    others = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    part = components(found.where("a <> b").select("a", "b")).withColumnRenamed("id", "rep").withColumnRenamed("component_id", "part")
    one = one.select(*_K, "rep", "least", "n").join(others, "rep", "left").join(part, "rep", "left")
    smallest = one.where("part is not null").groupBy("part").agg(F.min("least").alias("smallest"))
    one = one.join(smallest, "part", "left").select(*_K, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    one = materialise(one, "class-links")
    scratch.drop()
    got = rows.join(one, _K, "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
