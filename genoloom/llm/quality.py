"""Quality classifier: co-training of a content view and a metadata view.

The content view sees a document's text: hashed byte trigrams and the shape of its words and lines.  The metadata
view sees source, lang and length.  Each is a logistic regression; over some rounds each gives the documents of an
unlabelled pool that it is surest of, with its label, to the other's training set.  Both are then calibrated on
labelled documents that neither learned from, and their calibrated log-odds are combined.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .linear import logistic, pack, platt, scale_of, sigmoid, trigram_scores, trigram_shares, unpack
from .scratch import give_back, lean, small_batches
from .text import buffers, chunks, word_hashes, words

BITS = 11
_BINS = 64  # of the metadata view, for each of its fields
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[128:] = 5
N_SHAPE = 16


def shapes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text: shares of kinds of bytes, of repeated words and lines, and lengths."""
    out = np.zeros((len(at) - 1, N_SHAPE))
    for i, j in chunks(at):
        starts, ends, doc, low = words(data, at, i, j)
        hashes = word_hashes(low, starts, ends)
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        raw = data[at[i] : at[j]]
        for d in range(j - i):
            a, b = bounds[d], bounds[d + 1]
            s, e = at[i + d] - at[i], at[i + d + 1] - at[i]
            n, k = max(1, e - s), max(1, b - a)
            kinds = np.bincount(_KIND[raw[s:e]], minlength=6)
            h = hashes[a:b]
            size = ends[a:b] - starts[a:b]
            distinct = len(np.unique(h)) if b > a else 0
            lines = raw[s:e].tobytes().split(b"\n")
            row = out[i + d]
            row[0:6] = kinds / n
            row[6] = distinct / k
            row[7] = (h[1:] == h[:-1]).sum() / k
            row[8] = len(set(lines)) / len(lines)
            row[9] = len(lines) / k
            row[10] = np.log1p(k)
            row[11] = np.log1p(distinct) - 0.8 * np.log1p(k)
            row[12] = size.mean() / 10 if b > a else 0
            row[13] = (size <= 1).sum() / k
            row[14] = (size >= 20).sum() / k
            row[15] = kinds[1] / max(1, kinds[1] + kinds[2])
    return out


def shape_features(x: np.ndarray) -> np.ndarray:
    """Steps and squares of the shape, so that a linear model can bend."""
    return np.hstack([x, x * x, x[:, 6:8] < 0.3, x[:, 6:8] > 0.1, x[:, 8:9] < 0.7, x[:, 15:16] > 0.5, x[:, 0:1] > 0.08]).astype(np.float64)


def meta_features(source, lang, n_chars) -> np.ndarray:
    """One-hot hashed source, lang and their pair, and the logarithm of the length in steps and as such."""
    n = len(n_chars)
    out = np.zeros((n, 3 * _BINS + 24), np.float32)
    cache: dict[str, int] = {}
    for i in range(n):
        s, g = source[i] or "", lang[i] or ""
        for k, v in enumerate((s, g, f"{s}\x00{g}")):
            if v not in cache:
                cache[v] = zlib.crc32(v.encode()) % _BINS
            out[i, k * _BINS + cache[v]] = 1
        size = np.log1p(max(0, n_chars[i] or 0))
        out[i, 3 * _BINS + min(22, int(2 * size))] = 1
        out[i, -1] = size / 10
    return out


def _picked(batches):
    for batch in batches:
        data, at = buffers(batch.column(2))
        x, shape = trigram_shares(data, at, BITS), shapes(data, at).astype(np.float32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array(pack(x), pa.binary()), pa.array([v.tobytes() for v in shape], pa.binary())], names=["doc_id", "y", "source", "lang", "n_chars", "x", "shape"])


class Model:
    """Both views' weights, their calibration, their shares in the sum, and the threshold."""

    def __init__(self, shape_scale, shape_w, tri_w, text_b, meta_w, meta_b, calibration, mixing, cut):
        self.shape_scale, self.shape_w, self.tri_w, self.text_b = shape_scale, shape_w, tri_w, text_b
        self.meta_w, self.meta_b = meta_w, meta_b
        self.calibration, self.mixing, self.cut = calibration, mixing, cut

    def text_view(self, data, at) -> np.ndarray:
        z = trigram_scores(data, at, self.tri_w[:, None], BITS)[:, 0]
        return z + (shape_features(shapes(data, at)) * self.shape_scale) @ self.shape_w + self.text_b

    def meta_view(self, source, lang, n_chars) -> np.ndarray:
        return meta_features(source, lang, n_chars) @ self.meta_w + self.meta_b

    def combine(self, text_z, meta_z) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (a, b), (c, d) = self.calibration
        text_l, meta_l = np.clip(a * text_z + b, -20, 20), np.clip(c * meta_z + d, -20, 20)
        w, v, u = self.mixing
        return sigmoid(text_l), sigmoid(meta_l), sigmoid(w * text_l + v * meta_l + u)


def _fit(text, x_shape, x_meta, y, known, held, rounds: int, give: float, sure: float, keep_good: float) -> Model:
    # text: trigram shares, and room for the shape; filled in place
    n_tri = text.shape[1] - x_shape.shape[1]
    tri_scale, shape_scale = scale_of(text[:, :n_tri]), 1 / (x_shape.std(0) + 1e-6)
    text[:, :n_tri] *= 0.3 * tri_scale
    np.multiply(x_shape, shape_scale, out=text[:, n_tri:], casting="same_kind")
    views = [text, x_meta]
    train = np.flatnonzero(known & ~held)
    pool = np.flatnonzero(~known)
    lessons = [dict(zip(train, y[train], strict=True)) for _ in views]

    def learn(v):
        rows = np.array(list(lessons[v]), int)
        return logistic(views[v][rows], np.array([lessons[v][r] for r in rows], np.float64), 1e-3 if v == 0 else 1e-2)

    for _ in range(rounds):
        fitted = [learn(v) for v in (0, 1)]
        for v, other in ((0, 1), (1, 0)):
            free = np.array([r for r in pool if r not in lessons[other]], int)
            if not len(free):
                continue
            p = sigmoid(views[v][free] @ fitted[v][0] + fitted[v][1])
            share = y[train].mean()
            for label, order, many in ((1, np.argsort(-p, kind="stable"), share), (0, np.argsort(p, kind="stable"), 1 - share)):
                for r in order[: max(1, int(give * many * len(pool)))]:
                    if (p[r] if label else 1 - p[r]) >= sure:
                        lessons[other][free[r]] = label
    (w, b), (m, c) = (learn(v) for v in (0, 1))
    z = [text @ w + b, x_meta @ m + c]
    # calibrated on labels that no view learned from; the mixing too
    rows = np.flatnonzero(known & held)
    calibration = [platt(v[rows], y[rows]) for v in z]
    logits = np.stack([np.clip(s * v + o, -20, 20) for v, (s, o) in zip(z, calibration, strict=True)], 1)
    if len(rows) and 0 < y[rows].sum() < len(rows):
        mix, u = logistic(logits[rows], y[rows].astype(float), 1e-3, 500, balanced=False)
        mixing = (max(0.0, mix[0]), max(0.0, mix[1]), u)
    else:
        mixing = (1.0, 0.0, 0.0)
    p = sigmoid(logits @ np.array(mixing[:2]) + mixing[2])[rows]
    cut = 0.5
    if len(rows) and 0 < y[rows].sum() < len(rows):
        good, bad = np.sort(p[y[rows] == 1]), np.sort(p[y[rows] == 0])
        cuts = np.unique(np.concatenate([p, [0.5]]))
        lost, passed = np.searchsorted(good, cuts) / len(good), 1 - np.searchsorted(bad, cuts) / len(bad)
        allowed = lost <= 1 - keep_good
        worth = np.where(allowed, -passed - lost, -9)
        # between the chosen cut and the next score below it
        k = int(worth.argmax())
        cut = float((cuts[k] + cuts[k - 1]) / 2) if k else float(cuts[0])
    return Model(shape_scale, w[n_tri:], w[:n_tri] * tri_scale * 0.3, b, m, c, calibration, mixing, cut)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, max_pool: int = 2000, rounds: int = 4, give: float = 0.05, sure: float = 0.9, keep_good: float = 0.995) -> Model | None:
    """Learns from at most ``max_labelled`` labelled documents and a pool of ``max_pool`` others, those with the least
    hashes of doc_id.  A quarter of the labelled, by another hash, is held out for calibration and the threshold,
    which keeps at least ``keep_good`` of the good ones there.  Of rows with one doc_id one is learned from.  None
    without labels of both kinds."""
    votes = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = ids.join(votes, "doc_id").orderBy(*order).limit(max_labelled)
    other = ids.join(votes.select("doc_id"), "doc_id", "left_anti").orderBy(*order).limit(max_pool).withColumn("y", F.lit(None).cast("int"))
    picked = known.union(other)
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(picked), "doc_id").select("doc_id", F.col("y").cast("int"), "text", "source", "lang", F.col("n_chars").cast("long"))
    found = rows.mapInArrow(_picked, "doc_id long, y int, source string, lang string, n_chars long, x binary, shape binary")
    # one row a doc_id, before anything comes to the driver
    first = F.min(F.struct("x", "shape", "y", "source", "lang", "n_chars")).alias("r")
    found = found.groupBy("doc_id").agg(first).select("doc_id", "r.*").toPandas()
    if found.empty:
        return None
    found = found.sort_values("doc_id")
    shape = shape_features(np.frombuffer(b"".join(found["shape"]), np.float32).reshape(len(found), -1).astype(np.float64))
    known, y = found["y"].notna().to_numpy(), found["y"].fillna(0).to_numpy(int)
    if len(set(y[known])) < 2:
        return None
    held = np.array([zlib.crc32(f"q{i}".encode()) % 4 == 0 for i in found["doc_id"]])
    lists = [[None if v is None or v != v else v for v in found[c]] for c in ("source", "lang", "n_chars")]
    model = _fit(unpack(found.pop("x"), 1 << BITS, shape.shape[1]), shape, meta_features(*lists), y, known, held, rounds, give, sure, keep_good)
    del found
    give_back()
    return model


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text, source, lang, n_chars and any other columns) with p_text, p_meta, quality and keep.

    Null fields count as empty, a null n_chars as 0.  Without a model every row is kept at 0.5.  A null or empty
    text has no content and is not kept.  Columns of these names are replaced.  No shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("p_text", "p_meta", "quality", "keep")
    at_text, at_source, at_lang, at_n = (docs.columns.index(c) for c in ("text", "source", "lang", "n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, at = buffers(batch.column(at_text))
            if m is None:
                p = q = r = np.full(batch.num_rows, 0.5)
                keep = at[1:] > at[:-1]
            else:
                p, q, r = m.combine(m.text_view(data, at), m.meta_view(*(batch.column(c).to_pylist() for c in (at_source, at_lang, at_n))))
                keep = (r >= m.cut) & (at[1:] > at[:-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(q), pa.array(r), pa.array(keep)], names=[*batch.schema.names, "p_text", "p_meta", "quality", "keep"])

    add = [T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "quality")] + [T.StructField("keep", T.BooleanType())]
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *add]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, with what ``labels`` says of quality: doc_id, p_text, p_meta, quality, keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang", "source", "n_chars")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).select("doc_id", "p_text", "p_meta", "quality", "keep")
