"""Language ID: family first, then one-versus-one support vector machines within the family."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .linear import pack, scale_of, sigmoid, svm, trigram_scores, trigram_shares, unpack
from .scratch import give_back, lean, small_batches
from .text import buffers

UNKNOWN = "und"
#: Families of languages.  A language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi mr ne bn gu pa",
}
_FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs.split()}
BITS = 12


class Model:
    """Weights over trigram shares, one column a classifier: families against the rest, then pairs of languages.
    ``x`` is scaled in place."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.languages = sorted(set(lang))
        family = np.array([_FAMILY.get(v, v) for v in lang])
        self.families = sorted(set(family))
        scale, columns, self.bias = scale_of(x), [], []
        x *= scale

        def add(rows, y):
            w, b = svm(x[rows], y)
            columns.append(w * scale)
            self.bias.append(b)

        if len(self.families) > 1:
            for f in self.families:
                add(slice(None), np.where(family == f, 1.0, -1.0))
        self.pairs = []
        for f in self.families:
            for a, b in combinations(sorted(set(lang[family == f])), 2):
                rows = (lang == a) | (lang == b)
                add(rows, np.where(lang[rows] == a, 1.0, -1.0))
                self.pairs.append((f, a, b))
        self.weights = np.array(columns, np.float64).T if columns else np.zeros((x.shape[1], 0))

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text.

        Within the family that leads, the language with most pairs won; equal ones by the sum of their margins.
        The score is the share of the family's chance, times that of the language against its best rival.
        """
        z = trigram_scores(data, at, self.weights, BITS) + np.array(self.bias)[None, :]
        n, k = len(z), len(self.families) if len(self.families) > 1 else 0
        lead, score = np.zeros(n, int), np.ones(n)
        if k:
            p = sigmoid(3 * z[:, :k])
            lead = z[:, :k].argmax(1)
            score = p.max(1) / p.sum(1)
        out = np.empty(n, object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(lead == i)
            names = [v for v in self.languages if _FAMILY.get(v, v) == f]
            wins, margin, least = (np.zeros((len(rows), len(names))) for _ in range(3))
            least += 40
            for c, (g, a, b) in enumerate(self.pairs):
                if g == f:
                    m = z[rows, k + c]
                    for name, v in ((a, m), (b, -m)):
                        j = names.index(name)
                        wins[:, j] += v > 0
                        margin[:, j] += v
                        least[:, j] = np.minimum(least[:, j], v)
            best = (wins + 0.5 * np.tanh(margin / 100)).argmax(1)
            out[rows] = np.array(names, object)[best]
            score[rows] *= sigmoid(3 * least[np.arange(len(rows)), best])
        return out, score


def _shares(batches):
    for batch in batches:
        x = trigram_shares(*buffers(batch.column(1)), BITS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(x), pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, per_language: int = 500, most_languages: int = 1000) -> Model | None:
    """Learns from text and lang of ``docs`` (doc_id, text, lang): of each of the ``most_languages`` most frequent
    languages at most ``per_language`` rows with text, those with the least hashes of doc_id.  Those bounds are the
    size of what the driver sees.  Languages are counted over all rows first; a row whose hash is far above what its
    language's count asks for goes before anything is shuffled.  Repeated rows are learned from once."""
    known = docs.where("lang is not null and length(text) > 2")
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("rows"), "lang").limit(most_languages)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    rate = counts.select(F.col("lang").alias("l"), ((per_language + 8 * per_language**0.5 + 30) / F.col("n")).alias("rate"))
    near = known.select("doc_id", "lang", F.xxhash64("text").alias("t"), place.alias("place")).join(F.broadcast(rate), F.col("lang") == F.col("l")).where("place <= rate").drop("rate").distinct()
    nth = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", "t"))
    picked = near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("doc_id", "l", "t")
    sample = known.join(F.broadcast(picked), (known.doc_id == picked.doc_id) & (known.lang == picked.l) & (F.xxhash64(known.text) == picked.t), "left_semi").select("lang", "text")
    rows = sample.mapInArrow(_shares, "lang string, x binary").distinct().toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "x"])
    model = Model(unpack(rows.pop("x"), 1 << BITS), rows["lang"].to_numpy(object))
    del rows
    give_back()
    return model


def _has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; only texts without an ASCII one are decoded."""
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = 1
    out = np.zeros(len(at) - 1, bool)
    for d in range(len(out)):
        raw = data[at[d] : at[d + 1]]
        out[d] = ascii_letter[raw[:64]].any() or ascii_letter[raw].any() or any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text and any other columns) with lang_pred and score.

    Reads the whole text only: lang, source and doc_id are not looked at.  A text that is null or without a letter
    is ``und`` with score 0, as is every text where there was nothing to learn from.  Columns of these names are
    replaced.  Each row is predicted by itself: no shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    at_text = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(at_text))
            if shared.value is None:
                lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            else:
                lang, score = shared.value.predict(data, at)
                letters = _has_letter(data, at)
                lang[~letters], score[~letters] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(lean(run), schema)


def held_out(mod: int, rest: int):
    """crc32 of doc_id as text modulo ``mod`` is ``rest``; a null doc_id is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(True))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; those whose crc32(doc_id) mod 5 is 0 are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang")
    model = train(docs.where(~held_out(5, 0)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")
