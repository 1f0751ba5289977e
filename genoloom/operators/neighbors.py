"""Nearest neighbours in the plane and by cosine, and the normalised graph."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import dot, norm
from ..tables import cut


def knn_spatial(spots: DataFrame, k: int, keys: tuple = ("sample", "annotation"), cell: float | None = None) -> DataFrame:
    """(keys..., src, dst, distance, rank): the k nearest spots of each spot within its keys, itself included, by
    Euclidean distance and then by pos; a group of fewer than k gives all.  ``spots``: keys..., pos, sx, sy.

    Exact and without a cross join: spots are dealt to grid cells; each spot asks its own cell and the eight around it;
    it is done if it found k within one cell's width.  Those that are not ask again on a grid twice as wide, until all
    are done or the grid has but one cell around a group.  The first width is set so that a cell holds about k spots.
    """
    keys = list(keys)
    pts = spots.select(*keys, "pos", F.col("sx").cast("double"), F.col("sy").cast("double"))
    box = pts.groupBy(*keys).agg(F.count("*").alias("n"), F.min("sx").alias("x0"), F.min("sy").alias("y0"), F.greatest(F.max("sx") - F.min("sx"), F.max("sy") - F.min("sy")).alias("span"))
    width = F.lit(cell) if cell else F.greatest(F.col("span") * F.sqrt(F.lit(float(k)) / F.col("n")), F.col("span") / 1e6)
    box = box.withColumn("w", F.when(F.col("span") > 0, width).otherwise(1.0)).withColumn("need", F.least(F.lit(k), F.col("n")))
    pts = cut(pts.join(box, keys))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])

    def place(rows, width):
        return rows.withColumn("cx", F.floor((F.col("sx") - F.col("x0")) / width)).withColumn("cy", F.floor((F.col("sy") - F.col("y0")) / width))

    asking, out = pts, None
    for k_round in itertools.count():  # ends when a cell is wider than all groups
        wide = F.col("w") * 2.0**k_round
        cells = place(pts, wide).select(*keys, F.col("pos").alias("dst"), F.col("sx").alias("tx"), F.col("sy").alias("ty"), "cx", "cy")
        asked = place(asking, wide).withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy"))
        d = F.sqrt((F.col("sx") - F.col("tx")) ** 2 + (F.col("sy") - F.col("ty")) ** 2)
        w = W.partitionBy(*keys, "pos").orderBy("distance", "dst")
        near = asked.join(cells, [*keys, "cx", "cy"]).withColumn("distance", d).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("need"))
        # certain: the k-th lies within the width of one cell, or the cells cover the whole group
        whole = W.partitionBy(*keys, "pos")
        far, got = F.max("distance").over(whole), F.count("*").over(whole)
        near = cut(near.withColumn("sure", ((got == F.col("need")) & (far <= wide)) | (wide > F.col("span"))).select(*keys, F.col("pos").alias("src"), "dst", "distance", "rank", "sure"))
        done = near.where("sure").drop("sure")
        out = done if out is None else out.unionByName(done)
        left = near.where("not sure and rank = 1").select(*keys, F.col("src").alias("pos"))
        if left.isEmpty():
            break
        asking = cut(asking.join(left, [*keys, "pos"], "left_semi"))
    return out


def knn_exact(spots: DataFrame, k: int, keys: tuple = ("sample", "annotation")) -> DataFrame:
    """As ``knn_spatial``, in one task for each group: for groups that fit in memory."""
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        xy, pos = pdf[["sx", "sy"]].to_numpy(float), pdf["pos"].to_numpy()
        n, parts = len(pdf), []
        for a in range(0, n, 1024):
            d = np.sqrt(((xy[a : a + 1024, None] - xy[None]) ** 2).sum(2))
            order = np.argsort(d, axis=1, kind="stable")[:, : min(k, n)]
            parts.append(pd.DataFrame({"src": np.repeat(pos[a : a + 1024], order.shape[1]), "dst": pos[order.ravel()], "distance": np.take_along_axis(d, order, 1).ravel(), "rank": np.tile(np.arange(1, order.shape[1] + 1), len(order))}))
        out = pd.concat(parts)
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "src", "dst", "distance", "rank"]]

    types = dict(spots.dtypes)
    return spots.select(*keys, "pos", "sx", "sy").groupBy(*keys).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in keys) + f", src {types['pos']}, dst {types['pos']}, distance double, rank int")


def cosine_topk(edges: DataFrame, latent: DataFrame, k: int, keys: tuple = ("sample",)) -> DataFrame:
    """Of each source's edges the k with the largest cosine of latent vectors, then by dst.  A zero vector has none.
    ``edges``: keys..., src, dst; ``latent``: keys..., pos, vec."""
    keys = list(keys)
    a = latent.select(*keys, F.col("pos").alias("src"), F.col("vec").alias("va"), norm(F.col("vec")).alias("na"))
    b = latent.select(*keys, F.col("pos").alias("dst"), F.col("vec").alias("vb"), norm(F.col("vec")).alias("nb"))
    rows = edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    rows = rows.withColumn("similarity", F.when((F.col("na") > 0) & (F.col("nb") > 0), dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))))
    w = W.partitionBy(*keys, "src").orderBy(F.desc_nulls_last("similarity"), "dst")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "src", "dst", "similarity", "rank")


def normalized_graph(edges: DataFrame, gaussian: float | None = None) -> DataFrame:
    """(src, dst, w): D^-1/2 (A + I) D^-1/2 of edges (src, dst, distance); of distance 0 none is an edge.
    ``gaussian``: weights exp(-d^2 / (2 s^2)) instead of 1."""
    weight = F.lit(1.0) if gaussian is None else F.exp(-(F.col("distance") ** 2) / (2 * gaussian**2))
    a = edges.where("distance > 0").select("src", "dst", weight.alias("w"))
    # every node has a row here, with its own loop counted
    ends = edges.select("src", F.when(F.col("distance") > 0, weight).otherwise(0.0).alias("w")).union(edges.select("dst", F.lit(0.0)))
    degree = cut(ends.groupBy("src").agg((F.sum("w") + 1).alias("d")))
    of = degree.select(F.col("src").alias("dst"), F.col("d").alias("d2"))
    pairs = a.join(degree, "src").join(of, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("d2"))).alias("w"))
    return pairs.union(degree.select("src", "src", 1 / F.col("d")))


def mean_nearest_distance(spots: DataFrame, keys: tuple = ("sample",)) -> DataFrame:
    """Mean distance of each spot to its nearest other spot."""
    near = knn_spatial(spots, 2, keys).where("rank = 2")
    return near.groupBy(*keys).agg(F.avg("distance").alias("mean_distance"))
