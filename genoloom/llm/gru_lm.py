"""LM scoring: a gated recurrent language model with a class-factored output layer.

Frequent words have an output class each shares with up to 63 others; all other words fall into a few rare classes by
their spelling, and within a rare class by their counts over all training documents (add-one, with one place for
words never seen), so the model gives every text a probability.  The weights are learned by truncated
backpropagation, from a bounded sample first, then in every training task over its own texts; the tasks' weights are
averaged.  Vocabulary and counts come from all training documents.

1. a pass counts the words of the training documents: each task adds up its own, hash ranges add up the tasks';
2. the ``head`` most frequent words, a table of bounded size, go to all tasks; counts of all others stay in Spark;
3. a pass learns on from the training texts where they are, and sums up the tasks' weights by group;
4. a pass scores whole texts with the state carried from window to window; what it cannot know locally, the counts of
   a text's words beyond the head, is joined by the words' hashes and added up by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import held_out
from .linear import trigram_shares, trigrams
from .scratch import Scratch, give_back, lean, small_batches
from .text import buffers, chunks, word_hashes, words

BITS = 12
END = np.uint64(0x5EED0FE0D5EED0F5)
_COUNTS = [("h", np.uint64), ("c", np.int64), ("r", np.uint8)]


# --- spelling classes -------------------------------------------------------------------------------------------


def spelling_weights(shares: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """(2 ** BITS, k) log-odds of trigrams in k groups of sample texts, grouped by k-means on root shares."""
    x = np.sqrt(shares)
    centre = x[:1].copy()
    for _ in range(1, k):  # far points first
        d = ((x[:, None, :] - centre[None]) ** 2).sum(2).min(1)
        centre = np.vstack([centre, x[int(d.argmax())]])
    for _ in range(rounds):
        own = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        for j in range(k):
            if (own == j).any():
                centre[j] = x[own == j].mean(0)
    mean = shares.mean(0) + 1e-6
    return np.log(centre**2 + 0.05 * mean[None, :]).T - np.log(mean)[:, None]


def spelling_class(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rare class of each word, from its own bytes; words under 3 bytes are of class 0."""
    size = ends - starts
    cut = np.concatenate([[0], np.cumsum(size)])
    raw = low[np.repeat(starts - cut[:-1], size) + np.arange(cut[-1])]
    if len(raw) < 3:
        return np.zeros(len(starts), np.int64)
    h = trigrams(raw, BITS)
    stop = np.maximum(np.minimum(cut[1:] - 2, len(h)), 0)
    start = np.minimum(cut[:-1], stop)
    best, out = np.full(len(starts), -np.inf), np.zeros(len(starts), np.int64)
    run = np.zeros(len(h) + 1)
    for k, of_class in enumerate(np.ascontiguousarray(weights.T)):
        np.cumsum(of_class[h], out=run[1:])
        z = np.where(stop > start, run[stop] - run[start], 0.0)
        out[z > best + 1e-9] = k
        best = np.maximum(best, z)
    return out


# --- counts -----------------------------------------------------------------------------------------------------


def _merged(h, c, r):
    order = np.argsort(h, kind="stable")
    h, c, r = h[order], c[order], r[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(c, first) if len(h) else c, r[first]


def _count(weights, bits: int, most: int = 1_000_000):
    def run(batches):
        held: list[tuple] = []
        size = 0

        def parts():
            h, c, r = _merged(*(np.concatenate([x[k] for x in held]) for k in range(3)))
            held.clear()
            cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[cuts[k] : cuts[k + 1]].astype(t).tobytes() for k in full], pa.binary()) for x, (_, t) in zip((h, c, r), _COUNTS, strict=True))], names=["part", "h", "c", "r"])

        for batch in batches:
            data, at = buffers(batch.column(0))
            held.append((np.array([END]), np.array([batch.num_rows]), np.zeros(1, np.uint8)))
            for i, j in chunks(at):
                starts, ends, _, low = words(data, at, i, j)
                h, first, c = np.unique(word_hashes(low, starts, ends), return_index=True, return_counts=True)
                held.append((h, c, spelling_class(low, starts[first], ends[first], weights.value)))
                size += len(h)
            if size > most:
                yield parts()
                size = 0
        if held:
            yield parts()

    return run


def _add_up(batches):
    held: list[list[bytes]] = []
    now = None

    def done():
        h, c, r = _merged(*(np.frombuffer(b"".join(x[k] for x in held), t) for k, (_, t) in enumerate(_COUNTS)))
        return pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary())], names=["h", "c", "r"])

    for batch in batches:
        for part, *x in zip(*(v.to_pylist() for v in batch.columns), strict=True):
            if part != now and held:
                yield done()
                held.clear()
            now = part
            held.append(x)
    if held:
        yield done()


def _sums(n_rare: int):
    """Of each range: how many words have each count (in steps of a percent), and sums by rare class."""

    def run(batches):
        for batch in batches:
            for c, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                c, r = np.frombuffer(c, np.int64), np.frombuffer(r, np.uint8)
                step, many = np.unique(count_step(c), return_counts=True)
                keys = np.concatenate([step, -1 - np.arange(2 * n_rare)])
                n = np.concatenate([many, np.bincount(r, c, n_rare).astype(np.int64), np.bincount(r, minlength=n_rare)])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    return run


def count_step(c: np.ndarray) -> np.ndarray:
    """Counts to 1000 as they are, larger ones in steps of a percent; grows with the count."""
    return np.where(c <= 1000, c, 1000 + np.floor(100 * np.log(np.maximum(c, 1) / 1000))).astype(np.int64)


def _words(least: int, above: bool):
    def run(batches):
        for batch in batches:
            for h, c, r in zip(*(v.to_pylist() for v in batch.columns), strict=True):
                h, c, r = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(r, np.uint8)
                keep = (count_step(c) >= least) == above
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep]), pa.array(r[keep].astype(np.int32))], names=["h", "c", "r"])

    return run


# --- the network ------------------------------------------------------------------------------------------------


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Adam:
    """Steps along means of gradients, scaled by their spread; changes the weights in place."""

    def __init__(self, p: dict):
        self.p, self.n, self.mean = p, 0, {k: w.copy() for k, w in p.items()}
        self.m, self.v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))

    def step(self, grads: dict, tokens: int, rate: float) -> None:
        self.n += 1
        scale = 1 / tokens
        norm = scale * np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale *= min(1, 1 / max(norm, 1e-9))
        for k, g in grads.items():
            g *= scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.003 * (g * g - self.v[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.997**self.n)) + 1e-6)
            # of the steps so far, later ones counting for more: the noise of single steps goes
            self.mean[k] += (self.p[k] - self.mean[k]) * (2 / (self.n + 1))


class Gru:
    """Embedding, one gated recurrent layer, an output over classes and one within each frequent class.

    Inputs: 0 to F - 1 the frequent words, F to F + R - 1 the rare classes.  Outputs: classes of ``width`` frequent
    words, then the rare classes.
    """

    def __init__(self, n_frequent: int, n_rare: int, hidden: int, width: int, counts: np.ndarray):
        rng = np.random.default_rng(7)
        self.f, self.r, self.width = n_frequent, n_rare, width
        self.k = -(-n_frequent // width)
        c = self.k + n_rare
        smooth = counts + 0.5
        slots = np.full(self.k * width, 1e-9)
        slots[:n_frequent] = smooth[:n_frequent]
        slots = slots.reshape(self.k, width)
        mass = np.concatenate([slots.sum(1), smooth[n_frequent:]])
        g = lambda *s: (rng.normal(size=s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {
            "e": (0.3 * rng.normal(size=(n_frequent + n_rare, hidden))).astype(np.float32),
            "x": g(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "u": g(hidden, 3 * hidden),
            "c": 0.1 * g(hidden, c), "d": np.log(mass / mass.sum()).astype(np.float32),
            "o": 0.1 * g(self.k, hidden, width), "q": np.log(slots / slots.sum(1, keepdims=True)).astype(np.float32),
        }

    def copy(self) -> Gru:
        import copy

        out = copy.copy(self)
        out.p = {k: w.copy() for k, w in self.p.items()}
        return out

    def classes(self, y: np.ndarray) -> np.ndarray:
        return np.where(y < self.f, y // self.width, self.k + y - self.f)

    def loss_of(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, back: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probabilities of outputs y at states h; adds gradients of their negative sum if asked."""
        p, cls = self.p, self.classes(y)
        order = np.argsort(cls.astype(np.int16), kind="stable")  # rows of a class side by side
        h, y, cls, at = h[order], y[order], cls[order], np.arange(len(y))
        # an output a row: sums over outputs then run along the texts
        z = p["c"].T @ h.T
        z += p["d"][:, None]
        z -= z.max(0)
        got = z[cls, at]
        np.exp(z, out=z)
        total = z.sum(0)
        got -= np.log(total)
        if grads is not None:
            z /= total
            z[cls, at] -= 1
            grads["c"] += (z @ h).T
            grads["d"] += z.sum(1)
            to_h = z.T @ p["c"].T
        cuts = np.searchsorted(cls, np.arange(self.k + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            rows = slice(cuts[k], cuts[k + 1])
            hk, slot = h[rows], y[rows] - k * self.width
            z = p["o"][k].T @ hk.T
            z += p["q"][k][:, None]
            z -= z.max(0)
            at = np.arange(len(slot))
            got[rows] += z[slot, at]
            np.exp(z, out=z)
            total = z.sum(0)
            got[rows] -= np.log(total)
            if grads is not None:
                z /= total
                z[slot, at] -= 1
                grads["o"][k] += (z @ hk).T
                grads["q"][k] += z.sum(1)
                to_h[rows] += z.T @ p["o"][k].T
        if grads is not None:
            back[order] += to_h
        out = np.empty_like(got)
        out[order] = got
        return out

    def gradients(self, xs: np.ndarray, ys: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of a window of inputs and outputs (steps, lanes) from states h: gradients of the negative log-likelihood
        through all its steps, and the states after it."""
        p, (t_max, lanes), H = self.p, xs.shape, self.p["u"].shape[0]
        kind = p["u"].dtype
        a = np.take(p["e"] @ p["x"] + p["b"], xs, axis=0)
        hs = np.empty((t_max + 1, lanes, H), kind)
        rz, ns, gn = np.empty((t_max, lanes, 2 * H), kind), np.empty((t_max, lanes, H), kind), np.empty((t_max, lanes, H), kind)
        hs[0] = h
        g = np.empty((lanes, 3 * H), kind)
        for t in range(t_max):
            np.matmul(hs[t], p["u"], out=g)
            both, new = rz[t], ns[t]
            np.add(a[t, :, : 2 * H], g[:, : 2 * H], out=both)
            both *= 0.5
            np.tanh(both, out=both)
            both *= 0.5
            both += 0.5
            gn[t] = g[:, 2 * H :]
            np.multiply(both[:, :H], gn[t], out=new)
            new += a[t, :, 2 * H :]
            np.tanh(new, out=new)
            np.subtract(hs[t], new, out=hs[t + 1])
            hs[t + 1] *= both[:, H:]
            hs[t + 1] += new
        grads = {k: np.zeros_like(w) for k, w in p.items()}
        back = np.zeros((t_max * lanes, H), kind)
        self.loss_of(hs[1:].reshape(-1, H), ys.ravel(), grads, back)
        back = back.reshape(t_max, lanes, H)
        # by state: of the new value, of its share of the old one, of what it sees of the old one
        r, z = rz[:, :, :H], rz[:, :, H:]
        rest = 1 - rz
        to_n, to_z, to_r = ns * ns, hs[:-1] - ns, gn
        np.subtract(1, to_n, out=to_n)
        to_n *= rest[:, :, H:]
        to_z *= z
        to_z *= rest[:, :, H:]
        to_r *= r
        to_r *= rest[:, :, :H]
        da, dg = a, np.empty_like(a)
        d, ut = np.zeros((lanes, H), kind), np.ascontiguousarray(p["u"].T)
        for t in range(t_max - 1, -1, -1):
            d += back[t]
            own = dg[t]
            dn = d * to_n[t]
            np.multiply(dn, to_r[t], out=own[:, :H])
            np.multiply(d, to_z[t], out=own[:, H : 2 * H])
            np.multiply(dn, r[t], out=own[:, 2 * H :])
            da[t, :, 2 * H :] = dn
            d *= z[t]
            d += own @ ut
        da[:, :, : 2 * H] = dg[:, :, : 2 * H]
        grads["u"] += hs[:-1].reshape(-1, H).T @ dg.reshape(-1, 3 * H)
        da, seen = da.reshape(-1, 3 * H), xs.ravel()
        grads["x"] += p["e"][seen].T @ da
        grads["b"] += da.sum(0)
        # by input, each of them once
        order = np.argsort(seen.astype(np.int16 if len(p["e"]) < 1 << 15 else np.int64), kind="stable")
        inputs = seen[order]
        first = np.flatnonzero(np.concatenate([[True], inputs[1:] != inputs[:-1]]))
        grads["e"][inputs[first]] += np.add.reduceat((da @ p["x"].T)[order], first, 0)
        return grads, hs[-1].copy()

    def fit(self, stream: np.ndarray, lanes: int = 64, window: int = 24, steps: int = 1500, rate: float = 0.01) -> None:
        """Truncated backpropagation over parallel lanes of one stream of tokens; states go on between windows."""
        n = (len(stream) - 1) // lanes
        if n < 1:
            return
        x, y = stream[: lanes * n].reshape(lanes, n).T, stream[1 : lanes * n + 1].reshape(lanes, n).T
        adam, at = Adam(self.p), 0
        h = np.zeros((lanes, self.p["u"].shape[0]), np.float32)
        for step in range(1, steps + 1):
            if at >= n:
                at, h = 0, np.zeros_like(h)
            grads, h = self.gradients(x[at : at + window], y[at : at + window], h)
            adam.step(grads, len(x[at : at + window]) * lanes, rate * min(1, 2 * (1 - step / (steps + 1))))
            at += window

    def passages(self, stream: np.ndarray, adam: Adam, window: int = 24, many: int = 8, lanes: int = 64, rate: float = 0.002) -> int:
        """One pass over all of a stream, cut into passages of ``many`` windows, up to ``lanes`` of them side by side;
        the state goes on through a passage.  What does not fill the last one is learned from as its end, with tokens
        before it once more; a stream shorter than a passage is one by itself.  How many tokens the stream has."""
        n = len(stream) - 1
        if n < 1:
            return 0
        size = min(n, window * many)
        starts = np.append(np.arange(0, n - size, size), n - size)
        for own in np.array_split(starts, -(-len(starts) // lanes)):
            at = own[None, :] + np.arange(size)[:, None]
            x, y = stream[at], stream[at + 1]
            h = np.zeros((len(own), self.p["u"].shape[0]), np.float32)
            for k in range(0, size, window):
                grads, h = self.gradients(x[k : k + window], y[k : k + window], h)
                adam.step(grads, x[k : k + window].size, rate * min(1, (adam.n + 1) / 20))
        return n

    def scores(self, ids: np.ndarray, at: np.ndarray, end: int, room: int = 1 << 14) -> np.ndarray:
        """Log10-probability of each text ids[at[d]:at[d + 1]] and its end, the state carried through all of it.

        Texts go side by side, longest first, one token a step; outputs are taken whenever ``room`` states are full.
        """
        p, H = self.p, self.p["u"].shape[0]
        size = np.diff(at) + 1
        order = np.argsort(-size, kind="stable")
        start, length = at[:-1][order], size[order]
        out = np.zeros(len(order))
        table = p["e"] @ p["x"] + p["b"]
        h = np.zeros((len(order), H), np.float32)
        ids = np.append(ids, end)
        states, targets, docs, full = [], [], [], 0

        def flush():
            nonlocal full
            got = self.loss_of(np.concatenate(states), np.concatenate(targets))
            out[:] += np.bincount(np.concatenate(docs), got, len(out))
            states.clear(), targets.clear(), docs.clear()
            full = 0

        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right") if len(length) else []
        where = np.arange(len(order))
        x = np.full(len(order), end)
        for t, n in enumerate(active):
            h = h[:n]
            a = table[x[:n]]
            g = h @ p["u"]
            rz = a[:, : 2 * H]
            rz += g[:, : 2 * H]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            new = g[:, 2 * H :]
            new *= rz[:, :H]
            new += a[:, 2 * H :]
            np.tanh(new, out=new)
            h = h - new
            h *= rz[:, H:]
            h += new
            pos = start[:n] + t
            y = np.where(t + 1 < length[:n], ids[np.minimum(pos, len(ids) - 1)], end)
            states.append(h)
            targets.append(y)
            docs.append(where[:n])
            x = y
            full += n
            if full >= room:
                flush()
        if full:
            flush()
        result = np.empty(len(out))
        result[order] = out / np.log(10)
        return result


# --- learning from all training texts -----------------------------------------------------------------------------


class Places:
    """Where hashes are among ascending ones, found by their leading bits."""

    def __init__(self, h: np.ndarray):
        bits = min(24, len(h).bit_length() + 1)
        self.h, self.shift = h, np.uint64(64 - bits)
        self.first = np.append(np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(h)).astype(np.int32)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each x, and whether it is there at all."""
        if not len(self.h):
            return np.zeros(len(x), np.int32), np.zeros(len(x), bool)
        lead = (x >> self.shift).astype(np.int64)
        k, end = self.first[lead], self.first[lead + 1]
        hit = (k < end) & (self.h[np.minimum(k, len(self.h) - 1)] == x)
        rest = np.flatnonzero(~hit & (k + 1 < end))
        while len(rest):
            k[rest] += 1
            hit[rest] = self.h[k[rest]] == x[rest]
            rest = rest[~hit[rest] & (k[rest] + 1 < end[rest])]
        return k, hit


def _token_ids(low, starts, ends, places, ids_all, n_frequent, weights):
    """What the network reads of each word: its number among the frequent ones, else its spelling's class."""
    x = word_hashes(low, starts, ends)
    k, hit = places(x)
    ids = np.zeros(len(x), np.int64)
    ids[hit] = ids_all[k[hit]]
    miss = np.flatnonzero(~hit)
    ids[miss] = n_frequent + spelling_class(low, starts[miss], ends[miss], weights)
    return x, k, hit, ids


def _learn(shared, every: int, most: int = 4 << 20, groups: int = 64):
    """Each task goes on from the common weights over all tokens of its own texts, and gives its weights with the
    tokens learned from.  Only with ``every`` over 1: of the tokens of each few megabytes, whole texts in order, one
    run of an ``every``-th of them is learned from, at a place that moves on from one few megabytes to the next."""

    def run(batches):
        s = shared.value
        net = s.net.copy()
        adam, learned, turn, held, size, end = Adam(net.p), 0, 0, [], 0, np.array([s.end])

        def learn():
            nonlocal learned, turn
            stream = np.concatenate([end, *held]).astype(np.int32)
            run = -(-len(stream) // every)
            # few side by side at first, so that a small task takes steps enough
            learned += net.passages(stream[(turn % every) * run :][: run + 1], adam, lanes=512 if adam.n >= 150 else min(256, max(64, run // 4800)))
            turn += 1
            held.clear()

        seed = 0
        for batch in batches:
            data, at = buffers(batch.column(0))
            for i, j in chunks(at):
                starts, ends, doc, low = words(data, at, i, j)
                if not seed and len(starts):
                    turn = seed = 1 + int(word_hashes(low, starts[:1], ends[:1])[0] % np.uint64(97))
                _, _, _, ids = _token_ids(low, starts, ends, s.places, s.ids, net.f, s.weights)
                held.append(np.insert(ids, np.searchsorted(doc, np.arange(1, j - i + 1)), s.end))
                size += int(at[j] - at[i])
                if size >= most:
                    learn()
                    size = 0
        if held:
            learn()
        if learned:
            flat = np.concatenate([adam.mean[k].ravel() for k in sorted(net.p)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([(seed + learned) % groups], pa.int32()), pa.array([learned], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["g", "n", "w"])

    return run


def _mean(batches):
    """Weights of many tasks, by group in order, as one row a group: sums weighted by tokens.  Holds one sum."""
    now, n, total = None, 0, None
    for batch in batches:
        for g, m, w in zip(*(batch.column(k) for k in range(3)), strict=True):
            g, m = g.as_py(), m.as_py()
            if now is not None and g != now:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])
                n, total = 0, None
            now, part = g, m * np.frombuffer(w.as_buffer(), np.float32).astype(np.float64)
            n, total = n + m, part if total is None else total + part
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])


def learn_everywhere(train: DataFrame, shared, net: Gru, every: int, groups: int = 64) -> int:
    """Sets the weights of ``net`` to the mean over all training tasks, each weighted by its tokens; how many tokens.

    Tasks' weights are summed up by group, at most ``groups`` rows of one network's size come to the driver.
    """
    found = train.select("text").mapInArrow(lean(_learn(shared, every, groups=groups), 1 << 24), "g int, n long, w binary")
    found = found.repartition(groups, "g").sortWithinPartitions("g", "n", "w").mapInArrow(_mean, "n long, w binary").collect()
    total = sum(r["n"] for r in found)
    if total:
        flat = sum(r["n"] / total * np.frombuffer(r["w"], np.float32).astype(np.float64) for r in sorted(found, key=lambda r: (r["n"], bytes(r["w"]))))
        at = 0
        for k in sorted(net.p):
            w = net.p[k]
            net.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
    return total


# --- scoring ----------------------------------------------------------------------------------------------------


class Scorer:
    """What tasks need: the head of the counts, the network, the sums."""

    def __init__(self, net, weights, places, c, ids, rare, n, v, rare_n, rare_v, end):
        self.net, self.weights, self.places, self.h, self.c, self.ids, self.rare = net, weights, places, places.h, c, ids, rare
        self.n, self.v, self.rare_n, self.rare_v, self.end = n, v, rare_n, rare_v, end


def _score(shared, most: int = 24 << 20):
    """Texts of about ``most`` bytes go side by side: the longest of them takes as many steps alone or beside others."""

    def run(batches):
        s = shared.value
        f = s.net.f
        base_of = np.log10((s.c + 1) / (s.n + s.v + 1))
        rare_of = np.where(s.ids < f, 0.0, np.log10((s.c + 1) / (s.rare_n[s.rare] + s.rare_v[s.rare] + 1)))
        end_at = int(np.searchsorted(s.h, END))
        end_base = base_of[end_at] if end_at < len(s.h) and s.h[end_at] == END else np.log10(1 / (s.n + s.v + 1))

        def scored(group):
            keys, tokens, base, rare, known, tail, at = [], [], [], [], [], [], [0]
            ids_all = []
            for key, data, offsets in group:
                keys.append(key)
                for i, j in chunks(offsets):
                    starts, ends, doc, low = words(data, offsets, i, j)
                    h, k, hit, ids = _token_ids(low, starts, ends, s.places, s.ids, f, s.weights)
                    miss = np.flatnonzero(~hit)
                    cls = ids[miss] - f
                    ids_all.append(ids.astype(np.int32))
                    n_docs, kk = j - i, np.where(hit, k, 0)
                    tokens.append(np.bincount(doc, minlength=n_docs))
                    base.append(np.bincount(doc, np.where(hit, base_of[kk] if len(s.h) else 0, 0.0), n_docs) + end_base)
                    rare.append(np.bincount(doc, np.where(hit, rare_of[kk] if len(s.h) else 0, 0.0), n_docs))
                    known.append(np.bincount(doc[hit], minlength=n_docs) + (s.n > 0))
                    order = np.argsort(doc[miss], kind="stable")
                    at_doc = np.searchsorted(doc[miss][order], np.arange(n_docs + 1))
                    t = h[miss][order].view(np.int64), cls[order]
                    for d in range(n_docs):
                        a, b = at_doc[d], at_doc[d + 1]
                        tail.append((t[0][a:b], t[1][a:b].astype(np.int32)))
            tokens = np.concatenate(tokens)
            at = np.concatenate([[0], np.cumsum(tokens)])
            net = s.net.scores(np.concatenate(ids_all), at, s.end)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(tokens + 1, pa.int64()), pa.array(np.concatenate(known), pa.int64()), pa.array(np.concatenate(base)), pa.array(net + np.concatenate(rare)), pa.array([x for x, _ in tail], pa.list_(pa.int64())), pa.array([x for _, x in tail], pa.list_(pa.int32()))], names=["key", "n_tokens", "n_known", "base", "score", "h", "r"])

        group, size = [], 0
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            group.append((batch.column(0), data, offsets))
            size += int(offsets[-1] - offsets[0])
            if size >= most:
                yield scored(group)
                group, size = [], 0
        if group:
            yield scored(group)

    return run


def lm_scores(docs: DataFrame, train: DataFrame, *, n_frequent: int = 2048, n_rare: int = 6, hidden: int = 16, head: int = 1 << 18, sample: int = 1500, sample_bytes: int = 1 << 16, steps: int = 1500, every: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Tokens: words without ASCII white space, A-Z lower-cased, and one end.  base_score: the log10 probability by
    add-one counts over ``train`` (doc_id, text); score: the model's.  Counts and vocabulary come from all of
    ``train``.  The weights start from ``sample`` of its texts (the least hashes of doc_id; of each a passage of at
    most ``sample_bytes`` bytes, at a place that the hash says; spelling classes come from the same) and are then
    learned on in every training task over its own texts, very long ones included, and averaged: every token is
    learned from, or one in ``every`` where the caller says so.  A null or empty text is its end alone; a
    very long one is scored whole, the state carried.  Without training texts all words are new to both.  Repeated
    rows give repeated rows and are learned from as often; a null doc_id stays; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark)
    small_batches(spark)
    # a row a picked doc_id, cut before it travels
    ids_of = train.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    size = F.length("text")
    place = F.when(size > sample_bytes // 4, F.pmod(F.xxhash64("doc_id"), size - sample_bytes // 4 + 1)).otherwise(F.lit(0)).cast("int")
    passage = F.substring("text", place + 1, F.lit(sample_bytes // 4))
    some = train.join(F.broadcast(ids_of), "doc_id").select("doc_id", F.coalesce(passage, F.lit("")).alias("t")).groupBy("doc_id").agg(F.min("t").alias("t"))
    texts = sorted(r[0] for r in some.select("t").collect())
    data, at = buffers(pa.array(texts, pa.string()))
    long = np.flatnonzero(np.diff(at) > 2)
    weights = spelling_weights(trigram_shares(data, at, BITS)[long], min(n_rare, len(long))) if len(long) else np.zeros((1 << BITS, 1))
    n_rare = weights.shape[1]
    shared_weights = spark.sparkContext.broadcast(weights.astype(np.float32))
    bits = min(12, max(5, int(train.rdd.getNumPartitions()).bit_length() + 1))
    parts = train.select("text").mapInArrow(lean(_count(shared_weights, bits), 1 << 24), "part int, h binary, c binary, r binary")
    counts = parts.repartition(1 << max(3, bits - 1), "part").sortWithinPartitions("part").mapInArrow(lean(_add_up), "h binary, c binary, r binary")
    counts = scratch.table(counts, "counts")
    sums = {r["k"]: r["n"] for r in counts.mapInArrow(_sums(n_rare), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    rare_n, rare_v = (np.array([sums.get(-1 - k - o, 0) for k in range(n_rare)], np.int64) for o in (0, n_rare))
    n, v = int(rare_n.sum()), int(rare_v.sum())
    least, so_far = 1, 0
    for k in sorted((k for k in sums if k > 0), reverse=True):
        so_far += sums[k]
        if so_far > head:
            least = k + 1
            break
    top = counts.mapInArrow(_words(least, True), "h long, c long, r int").toPandas()
    top["h"] = top["h"].to_numpy(np.int64).view(np.uint64)
    top = top.sort_values("h").reset_index(drop=True)
    h, c, rare = top["h"].to_numpy(np.uint64), top["c"].to_numpy(np.int64), top["r"].to_numpy(np.int64)
    # frequent words, in order of rare class and count, so that a class holds words of alike spelling
    by_count = np.lexsort([h, -c])[:n_frequent]
    frequent = by_count[np.lexsort([h[by_count], -c[by_count], rare[by_count]])]
    ids = len(frequent) + rare
    ids[frequent] = np.arange(len(frequent))
    np.subtract.at(rare_n, rare[frequent], c[frequent])
    np.subtract.at(rare_v, rare[frequent], 1)
    in_head = np.searchsorted(h, END)
    end = int(ids[in_head]) if in_head < len(h) and h[in_head] == END else len(frequent)
    net = Gru(len(frequent), n_rare, hidden, 64, np.concatenate([c[frequent], rare_n]).astype(float))
    stream, places = [np.array([end], np.int32)], Places(h)
    for i, j in chunks(at):
        starts, ends, doc, low = words(data, at, i, j)
        own = _token_ids(low, starts, ends, places, ids, len(frequent), weights)[3]
        bounds = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            stream += [own[bounds[d] : bounds[d + 1]], [end]]
    if len(h):
        net.fit(np.concatenate(stream).astype(np.int32), steps=steps)
    del top, stream, texts, data
    give_back()
    known = Scorer(net, weights.astype(np.float32), places, c, ids, rare, n, v, rare_n, rare_v, end)
    if len(h):
        learn_everywhere(train, started := spark.sparkContext.broadcast(known), net, every)
        started.unpersist()
    scorer = spark.sparkContext.broadcast(known)
    local = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")).alias("key"), "text").mapInArrow(lean(_score(scorer), 1 << 24), "key struct<doc_id: long, row: long>, n_tokens long, n_known long, base double, score double, h array<long>, r array<int>")
    local = scratch.table(local, "local")
    tail = local.select("key.row", F.explode(F.arrays_zip("h", "r")).alias("t")).select("row", "t.h", "t.r")
    known = counts.mapInArrow(_words(least, False), "h long, c long, r int").select("h", "c")
    joined = tail.join(known, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sizes = F.array(*[F.lit(float(a + b + 1)) for a, b in zip(rare_n.tolist(), rare_v.tolist(), strict=True)])
    more = joined.groupBy("row").agg(F.sum(F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base2"), F.sum(F.log10((F.col("c") + 1) / F.get(sizes, F.col("r")))).alias("score2"), F.sum((F.col("c") > 0).cast("long")).alias("known2"))
    out = local.select("key.doc_id", "key.row", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
    zero = F.lit(0)
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known2", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base2", zero)).alias("base_score"), (F.col("score") + F.coalesce("score2", zero)).alias("score"))


def op9_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; those whose crc32(doc_id) mod 7 is 2 are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    out = lm_scores(docs, docs.where(~held_out(7, 2)))
    return out.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
