"""URL filters: prefix rules first, then a ratio of two character language models."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .scratch import Scratch

#: The rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words of hosts that are rejected seeds for training.
REJECT_WORDS = ("adult", "bet", "betting", "casino", "escort", "gambling", "malware", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
_START, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> Column:
    """(verdict, rule) of the longest rule that fits the host or a domain above it, and the path; else null."""
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _symbols(url: str) -> str:
    """What the models read: lower case, digits alike, no scheme."""
    x = url.lower().partition("://")
    return "".join("0" if c.isdigit() else c for c in (x[2] or x[0]))


def _counts(order: int):
    def run(batches):
        grams: Counter = Counter()
        for pdf in batches:
            for bad, url in zip(pdf["bad"], pdf["url"], strict=True):
                x = _START * order + _symbols(url) + _END
                for i in range(order, len(x)):
                    for k in range(order + 1):
                        grams[(bad, x[i - k : i + 1])] += 1
                if len(grams) > 500_000:
                    yield pd.DataFrame([(b, g, n) for (b, g), n in grams.items()], columns=["bad", "gram", "n"])
                    grams.clear()
        yield pd.DataFrame([(b, g, n) for (b, g), n in grams.items()], columns=["bad", "gram", "n"]).astype({"n": "int64"})

    return run


class Model:
    """A smoothed variable-order Markov model: each context that was kept is interpolated with the next shorter one
    by the number of its different successors (Witten-Bell); a context that was not kept is the shorter one.

    ``contexts`` gives total and number of successors of contexts as they were before ``grams`` were cut to size
    (those it lacks lost nothing).  What a context saw of successors that were cut goes to the shorter context, so
    probabilities still sum to one."""

    def __init__(self, grams: dict[str, int], order: int, alphabet: int = 256, contexts: dict[str, tuple[int, int]] | None = None):
        self.order, self.alphabet, self.grams = order, alphabet, grams
        kept: Counter = Counter()
        kinds: Counter = Counter()
        for g, n in grams.items():
            kept[g[:-1]] += n
            kinds[g[:-1]] += 1
        #: of each context the sum of all weights, and the weight of the next shorter context
        self.weights = {}
        for x, n in kept.items():
            total, many = (contexts or {}).get(x, (n, kinds[x]))
            self.weights[x] = (total + many, total - n + many)

    @classmethod
    def whole(cls, grams: dict[str, int], contexts: dict[str, tuple[int, int]], order: int) -> Model:
        """Of runs of which nothing was cut, given only those that some urls ask for, with all their contexts."""
        out = cls(grams, order)
        out.weights = {x: (total + many, many) for x, (total, many) in contexts.items()}
        return out

    def p(self, context: str, c: str) -> float:
        out = 1 / self.alphabet
        for k in range(len(context) + 1):
            x = context[len(context) - k :]
            if x not in self.weights:
                break
            total, shorter = self.weights[x]
            out = (self.grams.get(x + c, 0) + shorter * out) / total
        return out


class Ratio:
    """Mean over a url's characters of log10 P(accepted) - log10 P(rejected), with a bounded memory of contexts."""

    def __init__(self, accepted: Model, rejected: Model):
        self.models, self.order, self.seen = (accepted, rejected), accepted.order, {}

    def __call__(self, url: str) -> float:
        x, total = _START * self.order + _symbols(url) + _END, 0.0
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        for i in range(self.order, len(x)):
            g = x[i - self.order : i + 1]
            v = self.seen.get(g)
            if v is None:
                a, r = (m.p(g[:-1], g[-1]) for m in self.models)
                v = self.seen[g] = math.log10(a / r)
            total += v
        return total / (len(x) - self.order)


def _ratios(models):
    def run(batches):
        ratio = Ratio(*models.value)
        for pdf in batches:
            pdf["ratio"] = [ratio(u) if u else 0.0 for u in pdf["url"].fillna("")]
            yield pdf

    return run


def count_runs(labelled: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(bad, gram, n) of all runs of up to ``order`` + 1 characters of ``labelled`` (url string, bad boolean)."""
    counted = labelled.mapInPandas(_counts(order), "bad boolean, gram string, n long").groupBy("bad", "gram").agg(F.sum("n").alias("n"))
    return scratch.table(counted, "grams")


_CONTEXT = "left(gram, length(gram) - 1)"


def train(labelled: DataFrame, order: int = 5, max_grams: int = 200_000, scratch: Scratch | None = None) -> tuple[Model, Model]:
    """Models of accepted and of rejected urls from ``labelled`` (url string, bad boolean), counted over all its rows.

    Of each class the ``max_grams`` most frequent runs of up to ``order`` + 1 characters stay: the bound of the
    models' size.  Totals and numbers of successors of the contexts that stay are those of all runs, so the bound does
    not bend the smoothing.  ``filter_urls`` takes these models where the bound cuts nothing, else ``ratios_by_join``.
    """
    return _models(count_runs(labelled, order, scratch or Scratch(labelled.sparkSession)), order, max_grams)


def _models(counted: DataFrame, order: int, max_grams: int) -> tuple[Model, Model]:
    out = []
    for bad in (False, True):
        own = counted.where(F.col("bad") == bad).select("gram", "n", F.expr(_CONTEXT).alias("context"))
        top = own.orderBy(F.desc("n"), "gram").limit(max_grams)
        # at most max_grams contexts: what is broadcast, and what comes back
        sums = own.join(F.broadcast(top.select("context").distinct()), "context", "left_semi").groupBy("context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
        contexts = dict(zip(sums["context"], zip(sums["n"].tolist(), sums["kinds"].tolist(), strict=True), strict=True))
        kept = top.select("gram", "n").toPandas()
        out.append(Model(dict(zip(kept["gram"], kept["n"].tolist(), strict=True)), order, contexts=contexts))
    return out[0], out[1]


def _parts(most: int):
    """Rows with ``part``, a number that rows of about ``most`` characters of urls have in common."""

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += int(pdf["url"].str.len().sum())
            if size >= most:
                yield pd.concat(held).assign(part=first)
                first, held, size = first + 1, [], 0
        if held:
            yield pd.concat(held).assign(part=first)

    return run


def _runs_of(order: int):
    """Of each part all different runs and contexts that its urls ask for."""

    def run(batches):
        for pdf in batches:
            for part, urls in pdf.groupby("part")["url"]:
                asked = set()
                for url in urls.dropna().unique():
                    x = _START * order + _symbols(url) + _END
                    for i in range(order, len(x)):
                        for k in range(order + 1):
                            asked.add(x[i - k : i + 1])
                            asked.add(x[i - k : i])
                yield pd.DataFrame({"part": part, "x": sorted(asked)}).astype({"part": "int64", "x": "str"})

    return run


def ratios_by_join(rows: DataFrame, counted: DataFrame, order: int, scratch: Scratch, most: int = 1 << 17) -> DataFrame:
    """``rows`` (url string, and others) with ``ratio`` by models of all runs in ``counted``, however many: what the
    urls of a part ask for is joined with the counts, so that no task holds more than its part's share of a model."""
    parted = scratch.table(rows.mapInPandas(_parts(most), StructType([*rows.schema, StructField("part", LongType())])), "parts")
    of = lambda bad, n: F.sum(F.when(F.col("bad") == bad, n).otherwise(0))
    both = lambda n, name: [of(bad, n).alias(f"{name}{int(bad)}") for bad in (False, True)]
    none = [F.lit(0).cast("long").alias(c) for c in ("n0", "n1", "t0", "t1", "k0", "k1")]
    runs = counted.groupBy(F.col("gram").alias("x")).agg(*both(F.col("n"), "n")).select("x", "n0", "n1", *none[2:])
    contexts = counted.groupBy(F.expr(_CONTEXT).alias("x")).agg(*both(F.col("n"), "t"), *both(F.lit(1).cast("long"), "k")).select("x", *none[:2], "t0", "t1", "k0", "k1")
    facts = runs.unionByName(contexts).groupBy("x").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1", "k0", "k1")])
    asked = parted.select("part", "url").mapInPandas(_runs_of(order), "part long, x string").join(facts, "x")

    def score(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        models = []
        for c in "01":
            seen, known = found[found[f"n{c}"] > 0], found[found[f"t{c}"] > 0]
            contexts = zip(known[f"t{c}"].tolist(), known[f"k{c}"].tolist(), strict=True)
            models.append(Model.whole(dict(zip(seen["x"], seen[f"n{c}"].tolist(), strict=True)), dict(zip(known["x"], contexts, strict=True)), order))
        ratio = Ratio(*models)
        return own.drop(columns="part").assign(ratio=[ratio(u) if u else 0.0 for u in own["url"].fillna("")])

    return parted.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(score, StructType([*rows.schema, StructField("ratio", DoubleType())]))


def calibrate(scored: DataFrame, step: float = 0.005, span: float = 4.0) -> float:
    """The ratio below which a url is blocked: least mean error of both classes over ``scored`` (ratio, bad).

    Ratios are counted in bins of ``step``, so what comes to the driver does not grow.  Among equals the middle.
    """
    n = int(2 * span / step)
    bins = scored.select("bad", F.least(F.greatest(F.floor((F.col("ratio") + span) / step), F.lit(0)), F.lit(n - 1)).cast("int").alias("k")).groupBy("bad", "k").count().collect()
    good, bad = np.zeros(n), np.zeros(n)
    for r in bins:
        (bad if r["bad"] else good)[r["k"]] = r["count"]
    if not good.sum() or not bad.sum():
        return 0.0
    error = np.concatenate([[0], np.cumsum(good)]) / good.sum() + 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2] * step - span)


def filter_urls(pages: DataFrame, rules=RULES, reject_words=REJECT_WORDS, order: int = 5, max_grams: int = 200_000) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of each row of ``pages`` (page_id, url; other columns are ignored).

    Accepted urls for training are those that a rule allows and no seed word rejects; rejected ones are those that a
    rule blocks or whose host holds a word of ``reject_words``.  A fifth of them, by a hash of the url, is held out
    to set the threshold.  Rules go before the models.  The models are of all runs of characters: where a class has at
    most ``max_grams`` they go to all tasks, else their counts are joined, with the same results.  A null or empty url has ratio 0 and, as one without a rule,
    is allowed; so are all others when either class is empty.  Repeated rows give repeated rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    seed = F.arrays_overlap(F.split("host", "[^a-z]+"), F.array(*[F.lit(w) for w in reject_words]))
    bad = seed | F.coalesce(F.col("r.verdict") == "block", F.lit(False))
    known = (F.col("r").isNotNull() | seed) & (F.length("url") > 0)
    out = F.pmod(F.crc32("url"), F.lit(5)) == 0
    scratch = Scratch(spark)
    counted = count_runs(rows.where(known & ~out).select("url", bad.alias("bad")), order, scratch)
    sizes = [r["count"] for r in counted.groupBy("bad").count().collect()]
    flat = rows.select("page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), F.when(known & out, bad).alias("bad"))
    if len(sizes) < 2:
        cut, scored = 0.0, flat.withColumn("ratio", F.lit(0.0))
    elif max(sizes) > max_grams:
        scored = scratch.table(ratios_by_join(flat, counted, order, scratch), "scored")
        cut = calibrate(scored.where("bad is not null"))
    else:
        shared = spark.sparkContext.broadcast(_models(counted, order, max_grams))
        ratios = lambda df: df.mapInPandas(_ratios(shared), StructType([*flat.schema, StructField("ratio", DoubleType())]))
        cut, scored = calibrate(ratios(flat.where("bad is not null"))), ratios(flat)
    fallen = (F.col("ratio") < cut) & (F.length("url") > 0)
    judged = F.coalesce("verdict", F.when(F.coalesce(fallen, F.lit(False)), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), "ratio")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("ratio")
