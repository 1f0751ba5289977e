"""Embedding near-dedup: a pivot-permutation index with inverted lists, then exact verification.

Each vector is described by its ``nearest`` closest reference points (pivots).  Two vectors are candidates when they
share at least ``shared`` of them.  Such a pair has its first shared pivot, in one order of the pivots (rare first),
among the first nearest - shared + 1 of both, so a vector stands in that many inverted lists only, and a pair is
taken up in the list of its first shared pivot and nowhere else.  A list of more than ``crowd`` vectors is dealt out
once more by the second shared pivot (in the same way, with one place more), so lists follow the table's size over
the square of the number of pivots where the table is large; the pairs met are the same.  Pivots come from a bounded
sample; all vectors are indexed.  A list is cut into blocks of at most ``block`` vectors on average; each pair of
blocks counts shared pivots and verifies cosines by matrix products, and gives back numbers of links and a spanning
forest, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .jaccard_join import forest
from .scratch import Scratch


def pick_pivots(vectors: DataFrame, n: int, sample: int = 4096, least: int = 128, most: int = 2048, apart: float = 0.7) -> np.ndarray:
    """Unit reference points from the ``sample`` vectors with the least hashes: about the square root of ``n``, times
    1.25, between ``least`` and ``most``, so that lists stay short as the table grows.  Rare ones come first."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding"), "vec_id").limit(sample).toPandas()["embedding"]
    if rows.empty:
        return np.zeros((0, 1))
    size = pd.Series([len(v) for v in rows]).mode()[0]
    x = np.array([np.asarray(v, np.float64) for v in rows if len(v) == size])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    many = min(len(x), int(np.clip(1.25 * math.sqrt(n), least, most)))
    x = x[np.random.default_rng(0).permutation(len(x))]
    # points of one crowd would be nearest in no stable order: each pivot is away from those before it
    picked, free = [], np.ones(len(x), bool)
    while len(picked) < many and free.any():
        picked.append(int(free.argmax()))
        free &= x @ x[picked[-1]] < apart
    chosen, many = x[picked], len(picked)
    near = (x @ chosen.T).argsort(1)[:, -8:]
    return chosen[np.argsort(np.bincount(near.ravel(), minlength=many), kind="stable")]


def _describe(pivots, nearest: int):
    def run(batches):
        p = pivots.value
        for pdf in batches:
            out = []
            for v in pdf["embedding"]:
                v = np.asarray(v, np.float64)
                if len(v) != p.shape[1]:  # other sizes meet by size alone
                    out.append(np.array([-len(v)], np.int32))
                    continue
                top = np.argpartition(-(p @ v), min(nearest, len(p)) - 1)[:nearest]
                out.append(np.sort(top).astype(np.int32))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "k": pdf["k"], "e": [np.asarray(v, np.float64).tobytes() for v in pdf["embedding"]], "near": out})

    return run


def _meet(n_pivots: int, shared: int, cosine: float):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pivot, second, i, j = (int(k) for k in key[1:5])
        pdf = pdf.sort_values("vec_id")
        ids, many, side = pdf["vec_id"].to_numpy(np.int64), pdf["k"].to_numpy(np.int64), pdf["own"].to_numpy()
        x = np.array([np.frombuffer(b, np.float64) for b in pdf["e"]])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= cosine
        if pivot >= 0:
            m = np.zeros((len(ids), n_pivots), np.float32)
            m[np.repeat(np.arange(len(ids)), [len(v) for v in pdf["near"]]), np.concatenate(list(pdf["near"]))] = 1
            near &= m @ m.T >= shared
            if pivot:
                near &= m[:, :pivot] @ m[:, :pivot].T == 0
            if second >= 0:  # nothing shared between the first and the second
                near &= m[:, pivot + 1 : second] @ m[:, pivot + 1 : second].T == 0
        if i != j:  # pairs within a block are that block's own
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        links = near @ many
        label = forest(near, ids)
        rows = links > 0
        return pd.DataFrame({"a": ids[rows], "links": links[rows], "b": label[rows]})

    return run


def near_dups(vectors: DataFrame, *, cosine: float = 0.98, nearest: int = 8, shared: int = 4, block: int = 1024, crowd: int = 4096, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Compared within equal labels by cosine in double precision.  A vector that is null, empty, zero or holds a null
    or a non-finite value, or whose label is null, links with nothing.  Equal vectors of a label are one class and
    are linked; repeated rows count as vectors of their own.  Vectors of an unusual size are compared with all of
    their size.  A null vec_id stays, without links.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("string"))
    sound = "vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(embedding, v -> v <> 0)"
    rows = rows.withColumn("ok", F.coalesce(F.expr(sound), F.lit(False))).withColumn("h", F.xxhash64("embedding")).withColumn("g", F.hash("embedding"))
    classes = rows.where("ok").groupBy("label", "h", "g").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"), F.count("*").alias("k"))
    classes = scratch.table(classes, "classes")
    pivots = pick_pivots(classes, classes.count())
    if not len(pivots):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    held = spark.sparkContext.broadcast(pivots)
    described = classes.select("vec_id", "label", "k", "embedding").mapInPandas(_describe(held, nearest), "vec_id long, label string, k long, e binary, near array<int>")
    described = scratch.table(described, "described")
    short = max(1, min(nearest, len(pivots)) - shared + 1)
    least = min(shared, len(pivots))
    posted = described.withColumn("pivot", F.explode(F.slice("near", 1, short)))
    size = posted.groupBy("label", "pivot").agg(F.count("*").alias("size")).where("size > 1")
    posted = posted.join(size, ["label", "pivot"])
    # a crowded list by the second shared pivot too, which is after the first and one place further at most; a pair
    # of a list that is not dealt out (pivot -1: other sizes, or one shared pivot is enough) has none
    seconds = F.when((F.col("size") > crowd) & (F.col("pivot") >= 0), F.filter(F.slice("near", 1, short + 1), lambda q: q > F.col("pivot"))) if least > 1 else F.lit(None).cast("array<int>")
    posted = posted.withColumn("second", F.explode(F.coalesce(seconds, F.array(F.lit(-1))))).drop("size")
    lists = posted.groupBy("label", "pivot", "second").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"), F.count("*").alias("size")).where("size > 1").drop("size")
    placed = posted.join(lists, ["label", "pivot", "second"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    pairs = placed.select("label", "pivot", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "k", "e", "near")
    met = scratch.table(pairs.groupBy("label", "pivot", "second", "i", "j").applyInPandas(_meet(len(pivots), least, cosine), "a long, links long, b long"), "met")
    label = components(met.select("a", "b"), scratch)
    links = met.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.select("label", "h", "g", F.col("vec_id").alias("rep"), "k").join(links, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "h", "g", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.withColumn("key", F.when(F.col("ok"), F.col("label"))).join(named.withColumnRenamed("label", "key"), ["key", "h", "g"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: By all pairs of a label, and all that a vector reaches: for the small sizes.
OP8_SQL = """
with recursive v as materialized (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id
  where case when len(x.e) = len(y.e) then list_cosine_similarity(x.e, y.e) >= 0.98 else false end),
k as (select a, count(*) as k from l group by a),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as c from r group by a)
select d.vec_id, coalesce(k, 0) as n_links, coalesce(c, d.vec_id) as component_id, d.vec_id = coalesce(c, d.vec_id) as kept
from embeddings d left join k on k.a = d.vec_id left join c on c.a = d.vec_id
"""
