"""A latent of spots from a graph-attention auto-encoder, in numpy, learned in tiles of the tissue."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from .regress import numbered

BETAS, EPS = (0.9, 0.999), 1e-8
SLOPE = 0.2  # of the attention's leaky rectifier
MOMENTUM, SMALL = 0.1, 1e-5  # of batch normalisation


@dataclass(frozen=True)
class Shape:
    """Sizes of the layers and how they are learned."""

    hidden1: int = 256
    hidden2: int = 128
    gat1: int = 64
    gat2: int = 30
    heads: int = 3
    drop: float = 0.1
    rate: float = 0.001
    decay: float = 0.01
    epochs: int = 300
    least_epochs: int = 200
    threshold: float = 1e-4
    label_weight: float = 1.0
    rec_weight: float = 1.0
    seed: int = 2024


class Net:
    """Two dense blocks, two attention layers, and back: a decoder and, with labels, a classifier of the latent."""

    def __init__(self, width: int, labels: int, shape: Shape, dtype=np.float32):
        self.shape, self.labels, self.dtype = shape, labels, dtype
        rng = np.random.default_rng(shape.seed)
        self.p, self.stats = {}, {}

        def dense(name, a, b):
            bound = a**-0.5
            self.p[name + "w"], self.p[name + "b"] = rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)

        def block(name, a, b):
            dense(name, a, b)
            self.p[name + "g"], self.p[name + "s"] = np.ones(b), np.zeros(b)
            self.stats[name + "m"], self.stats[name + "v"] = np.zeros(b), np.ones(b)

        def attention(name, a, heads, b):
            bound, near = (6 / (a + heads * b)) ** 0.5, (6 / (heads + b)) ** 0.5
            self.p[name + "w"] = rng.uniform(-bound, bound, (a, heads * b))
            self.p[name + "f"], self.p[name + "t"] = rng.uniform(-near, near, (heads, b)), rng.uniform(-near, near, (heads, b))
            self.p[name + "b"] = np.zeros(heads * b)

        s = shape
        block("e1", width, s.hidden1), block("e2", s.hidden1, s.hidden2)
        attention("a1", s.hidden2, s.heads, s.gat1), attention("a2", s.heads * s.gat1, 1, s.gat2)
        block("d1", s.gat2, s.hidden2), block("d2", s.hidden2, s.hidden1), dense("d3", s.hidden1, width)
        if labels:
            block("c1", s.gat2, s.hidden2), dense("c2", s.hidden2, labels)
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}
        self.stats = {k: v.astype(dtype) for k, v in self.stats.items()}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.step = 0

    # a state is one vector, so that those of tiles can be averaged
    def _all(self):
        return [d[k] for d in (self.p, self.stats, self.first, self.second) for k in sorted(d)]

    def state(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self._all()]).astype(np.float32)

    def load(self, state: np.ndarray, step: int) -> Net:
        at = 0
        for v in self._all():
            v[...] = state[at : at + v.size].reshape(v.shape)
            at += v.size
        self.step = step
        return self

    # each layer gives its output and a function from the output's gradient to the input's, which adds to ``self.g``
    def _dense(self, name, x):
        def back(d):
            self.g[name + "w"] += x.T @ d
            self.g[name + "b"] += d.sum(0)
            return d @ self.p[name + "w"].T

        return x @ self.p[name + "w"] + self.p[name + "b"], back

    def _drop(self, x, rng):
        if rng is None or not self.shape.drop:
            return x, lambda d: d
        keep = ((rng.random(x.shape) >= self.shape.drop) / (1 - self.shape.drop)).astype(x.dtype)
        return x * keep, lambda d: d * keep

    def _block(self, name, x, rng):
        y, dense = self._dense(name, x)
        m, v = self.stats[name + "m"], self.stats[name + "v"]
        if rng is not None:
            mean, var = y.mean(0), y.var(0)
            m += MOMENTUM * (mean - m)
            v += MOMENTUM * (var * len(y) / max(1, len(y) - 1) - v)
        else:
            mean, var = m, v
        over = 1 / np.sqrt(var + SMALL)
        z = (y - mean) * over
        u = z * self.p[name + "g"] + self.p[name + "s"]
        out = np.where(u > 0, u, np.expm1(np.minimum(u, 0)))
        out, drop = self._drop(out, rng)

        def back(d):
            d = drop(d) * np.where(u > 0, 1, np.exp(np.minimum(u, 0)))
            self.g[name + "g"] += (d * z).sum(0)
            self.g[name + "s"] += d.sum(0)
            d = d * self.p[name + "g"]
            return dense(over * (d - d.mean(0) - z * (d * z).mean(0)))

        return out, back

    def _attention(self, name, x, graph, rng):
        to, of, starts, by_of, of_starts = graph  # edges by target; every node has one to itself
        frm, tgt = self.p[name + "f"], self.p[name + "t"]
        h = (x @ self.p[name + "w"]).reshape(len(x), *frm.shape)
        raw = (h * frm).sum(2)[of] + (h * tgt).sum(2)[to]
        e = np.where(raw > 0, raw, SLOPE * raw)
        e = np.exp(e - np.maximum.reduceat(e, starts)[to])
        share = e / np.add.reduceat(e, starts)[to]
        used, drop = self._drop(share, rng)
        out = np.add.reduceat(used[:, :, None] * h[of], starts).reshape(len(x), -1) + self.p[name + "b"]

        def back(d):
            self.g[name + "b"] += d.sum(0)
            d = d.reshape(h.shape)[to]
            spread = drop((d * h[of]).sum(2))
            de = share * (spread - np.add.reduceat(share * spread, starts)[to]) * np.where(raw > 0, 1, SLOPE)
            df, dt = np.add.reduceat(de[by_of], of_starts), np.add.reduceat(de, starts)
            self.g[name + "f"] += (df[:, :, None] * h).sum(0)
            self.g[name + "t"] += (dt[:, :, None] * h).sum(0)
            dh = np.add.reduceat((used[:, :, None] * d)[by_of], of_starts) + df[:, :, None] * frm + dt[:, :, None] * tgt
            dh = dh.reshape(len(x), -1)
            self.g[name + "w"] += x.T @ dh
            return dh @ self.p[name + "w"].T

        return out, back

    def encode(self, x, graph, rng=None):
        backs = []
        for name in ("e1", "e2"):
            x, b = self._block(name, x, rng)
            backs.append(b)
        x, b = self._attention("a1", x, graph, rng)
        on = x > 0
        x, drop = self._drop(x * on, rng)
        z, last = self._attention("a2", x, graph, rng)

        def back(d):
            d = b(drop(last(d)) * on)
            for f in reversed(backs):
                d = f(d)
            return d

        return z, back

    def loss(self, x, graph, own: int, label, rng) -> float:
        """Of the first ``own`` spots, the others being their surroundings; gradients are in ``self.g``."""
        self.g = {k: np.zeros_like(v) for k, v in self.p.items()}
        z, encoder = self.encode(x, graph, rng)
        z = z[:own]
        y, b1 = self._block("d1", z, rng)
        y, b2 = self._block("d2", y, rng)
        y, b3 = self._dense("d3", y)
        miss = y - x[:own]
        out = self.shape.rec_weight * float((miss * miss).mean())
        d = b1(b2(b3(2 * self.shape.rec_weight * miss / miss.size)))
        if self.labels:
            c, c1 = self._block("c1", z, rng)
            c, c2 = self._dense("c2", c)
            c = np.exp(c - c.max(1, keepdims=True))
            c /= c.sum(1, keepdims=True)
            rows = np.arange(own)
            out += self.shape.label_weight * float(-np.log(np.maximum(c[rows, label], 1e-30)).mean())
            c[rows, label] -= 1
            d = d + c1(c2(self.shape.label_weight * c / own))
        whole = np.zeros((len(x), z.shape[1]), x.dtype)
        whole[:own] = d
        encoder(whole)
        return out

    def learn(self) -> None:
        """One step of Adam, with the weights' squares as a penalty."""
        self.step += 1
        a, b = BETAS
        for k, w in self.p.items():
            g = self.g[k] + self.shape.decay * w
            self.first[k] += (1 - a) * (g - self.first[k])
            self.second[k] += (1 - b) * (g * g - self.second[k])
            w -= self.shape.rate * (self.first[k] / (1 - a**self.step)) / (np.sqrt(self.second[k] / (1 - b**self.step)) + EPS)


def graph_of(n: int, src: np.ndarray, dst: np.ndarray):
    """Edges by target, one to itself among them, and the same by source."""
    to, of = np.concatenate([src, np.arange(n)]), np.concatenate([dst, np.arange(n)])
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    by_of = np.argsort(of, kind="stable")
    return to, of, np.searchsorted(to, np.arange(n)), by_of, np.searchsorted(of[by_of], np.arange(n))


def _unpacked(row, dtype=np.float32):
    x = np.frombuffer(row.x, np.float32).reshape(row.n, -1).astype(dtype)
    src, dst = np.frombuffer(row.edges, np.int32).reshape(2, -1)
    return x, graph_of(row.n, src, dst), np.frombuffer(row.label, np.int32)[: row.own]


def tiles(nodes: DataFrame, edges: DataFrame, tile: int) -> DataFrame:
    """(tile, n, own, pos array, x, label, edges): neighbouring spots, ``tile`` at most, and what two steps along the
    graph reach from them.  ``nodes``: pos, sx, sy, vec, label (int, -1: none); ``edges``: src, dst."""
    span = nodes.agg(*[f(c).alias(f"{n}_{c}") for c in ("sx", "sy") for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda c: F.coalesce(F.floor(F.try_divide((F.col(c) - F.col(f"lo_{c}")) * 65535, F.col(f"hi_{c}") - F.col(f"lo_{c}"))), F.lit(0)).cast("int")
    bits = lambda c: F.lpad(F.bin(cell(c)), 16, "0")
    # places in Z order: bits of both coordinates by turns
    z = F.concat(*[part for k in range(1, 17) for part in (F.substring("_x", k, 1), F.substring("_y", k, 1))])
    placed = nodes.crossJoin(F.broadcast(span)).select("pos", "vec", "label", bits("sx").alias("_x"), bits("sy").alias("_y")).withColumn("_z", z).drop("_x", "_y")
    placed = cut(numbered(placed, ["_z", "pos"]).withColumn("tile", F.floor(F.col("seq") / tile)).select("tile", "pos", "vec", "label"))
    own = placed.select("tile", F.col("pos").alias("src"))
    pairs = edges.select("src", "dst")
    near = own.join(pairs, "src").select("tile", F.col("dst").alias("src")).union(own).distinct()
    inner = cut(near.join(pairs, "src").distinct())  # edges into what the first attention layer has to give
    members = inner.select("tile", F.col("dst").alias("pos")).union(near.select("tile", "src")).distinct()
    members = members.join(placed.select(F.col("tile").alias("home"), "pos", "vec", "label"), "pos")
    rows = members.select("tile", "pos", "vec", "label", (F.col("home") == F.col("tile")).alias("mine"))

    def pack(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values(["mine", "pos"], ascending=[False, True])
        at = {p: i for i, p in enumerate(a["pos"])}
        e = np.array([[at[s], at[d]] for s, d in sorted(zip(b["src"], b["dst"], strict=True))], np.int32).reshape(-1, 2).T
        x = np.stack(a["vec"].to_list()).astype(np.float32)
        return pd.DataFrame([[a["tile"].iloc[0], len(a), int(a["mine"].sum()), a["pos"].to_list(), x.tobytes(), a["label"].to_numpy(np.int32).tobytes(), e.tobytes()]], columns=["tile", "n", "own", "pos", "x", "label", "edges"])

    shape = f"tile long, n int, own int, pos array<{dict(nodes.dtypes)['pos']}>, x binary, label binary, edges binary"
    links = inner.select(F.col("tile").alias("of"), "src", "dst")
    return rows.groupBy("tile").cogroup(links.groupBy("of")).applyInPandas(pack, shape)


def graph_latent(nodes: DataFrame, edges: DataFrame, shape: Shape | None = None, labels: int = 0, tile: int = 8192, turn: int = 10) -> DataFrame:
    """(pos, latent) of one sample: the second attention layer's output for each spot.

    ``nodes``: pos, sx, sy, vec, label (0 to ``labels`` - 1, where there are labels); ``edges``: src, dst, a spot and
    one that it attends to besides itself.  A sample of one tile is learned from as a whole.  A larger one is learned
    from in all tiles at once: each takes ``turn`` steps, then weights and the optimiser's moments are averaged on
    executors by shares of spots; the driver holds one state, whose size is that of the layers.  Same input and seed,
    same result.  A sample without a spot gives no row.
    """
    shape = shape or Shape()
    spark = nodes.sparkSession
    packed = cut(tiles(nodes, edges, tile))
    count = packed.count()
    if not count:
        return nodes.select("pos", F.lit(None).cast("array<double>").alias("latent")).limit(0)
    width = nodes.select(F.size("vec")).first()[0]
    state, step, before = Net(width, labels, shape).state(), 0, float("inf")
    turn = shape.epochs if count == 1 else turn

    def averaged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile")
        share = pdf["own"].to_numpy(float)
        total = sum(w * np.frombuffer(s, np.float32).astype(float) for w, s in zip(share, pdf["state"], strict=True)) / share.sum()
        out = pdf[["tile", "group", "own", "steps"]].iloc[:1].copy()
        out["own"], out["loss"], out["state"] = int(share.sum()), float((share * pdf["loss"]).sum() / share.sum()), [total.astype(np.float32).tobytes()]
        return out

    head = "tile long, group long, own long, steps int, loss double, state binary"

    def learner(sent, step: int, steps: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in pdf.itertuples():
                net = Net(width, labels, shape).load(sent.value, step)
                x, graph, label = _unpacked(row)
                rng = np.random.default_rng([shape.seed, step, row.tile])
                last = float("inf")
                for k in range(steps):
                    loss = net.loss(x, graph, row.own, label, rng)
                    net.learn()
                    if count == 1 and abs(loss - last) <= shape.threshold and k >= shape.least_epochs:
                        break
                    last = loss
                out.append([row.tile, row.tile // 64, row.own, net.step, loss, net.state().tobytes()])
            return pd.DataFrame(out, columns=["tile", "group", "own", "steps", "loss", "state"])

        return run

    while step < shape.epochs:
        sent, steps = spark.sparkContext.broadcast(state), min(turn, shape.epochs - step)
        done, many = packed.groupBy("tile").applyInPandas(learner(sent, step, steps), head), count
        while many > 1:  # 64 states at most meet in a task
            done = done.groupBy("group").applyInPandas(averaged, head).withColumn("tile", F.col("group")).withColumn("group", F.floor(F.col("group") / 64))
            many = -(-many // 64)
        got = done.first()
        sent.unpersist()
        state, step = np.frombuffer(got["state"], np.float32), step + steps
        if step > shape.least_epochs and abs(got["loss"] - before) <= shape.threshold:
            break
        before = got["loss"]
    sent = spark.sparkContext.broadcast(state)

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in pdf.itertuples():
            x, graph, _ = _unpacked(row)
            z, _ = Net(width, labels, shape).load(sent.value, step).encode(x, graph)
            parts.append(pd.DataFrame({"pos": row.pos[: row.own], "latent": list(z[: row.own].astype(float))}))
        return pd.concat(parts)

    return packed.groupBy("tile").applyInPandas(give, f"pos {dict(nodes.dtypes)['pos']}, latent array<double>")
