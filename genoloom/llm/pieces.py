"""SentencePiece encoding and decoding: N-best segmentations over the piece lattice.

A text is read with a space before it and its spaces as the piece mark.  No piece holds a mark behind another
character or a line feed, so a text falls into *units* (spaces and what follows to the next space; a line feed) whose
lattices are independent.  The forward Viterbi scores of a unit are computed for all new units of a chunk at once.
They are exact heuristics for a backward A* search, whose first N complete paths are the N best.  The N best of a
whole text change only those of its units that lose least by a change, so A* runs on N - 1 units of a text, and each
of the N best is the best path with those units' ids replaced; what a unit loses by its second-best path follows from
forward and backward scores of its edges.

A character without a piece is an edge at ``unknown`` below the worst learned piece and becomes its bytes' pieces, as does a
piece mark that the text itself holds; so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import lean, small_batches
from .text import buffers, chunks, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, OWN_MARK = "▁", "\udc00"  # of spaces; stands for the text's own in a lattice
_SLOTS = 17
_LONG = 48  # characters of a unit that is worked on by itself


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _SLOTS)).astype(np.int64)


class Pieces:
    """The pieces of a model file with their scores; nothing is trained."""

    def __init__(self, path: str = MODEL, unknown: float = 10.0):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.raw: list[bytes] = []
        byte = [0] * 256
        for i in range(m.vocab_size()):
            p = m.id_to_piece(i)
            self.score.append(m.get_score(i))
            if m.is_byte(i):
                byte[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.raw.append(b"")
            else:
                if MARK in p.lstrip(MARK) or "\n" in p:
                    raise ValueError("a piece goes beyond a unit")
                self.ids[p] = i
                self.raw.append(p.replace(MARK, " ").encode())
        self.byte = byte
        self.most = max(map(len, self.ids))
        # runs of marks have a score that says never; what is learned ends far above it
        self.unknown = min(self.score[i] for i in self.ids.values() if self.score[i] > -1e8) - unknown
        self._tables()

    def _tables(self) -> None:
        """By length: hashes of pieces, sorted, with their scores and ids."""
        by: dict[int, list] = {}
        for p, i in self.ids.items():
            by.setdefault(len(p), []).append((self._hash(p), self.score[i], i))
        self.tables = {}
        for n, rows in by.items():
            rows.sort()
            keys, score, which = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.float64, np.int64), strict=True))
            # a slot leads to the first of the pieces that share it, ``deep`` are the most that do
            slot = _slot(keys)
            keys, score, which = (x[np.argsort(slot, kind="stable")] for x in (keys, score, which))
            slot = np.sort(slot)
            first = np.searchsorted(slot, np.arange(1 << _SLOTS)).astype(np.int32)
            pad = lambda x, v: np.append(x, np.full(8, v, x.dtype))
            self.tables[n] = first, pad(keys, 0), pad(score, -np.inf), pad(which, -1), int(np.bincount(slot).max())
        self.raw_at = np.cumsum([0] + [len(b) for b in self.raw])
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # --- one unit at a time

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations: (score, ends of pieces), best first.

        The forward pass gives each position its Viterbi score, the piece that it comes by (of equal ones the shorter),
        and the n - 1 cheapest turns off the best path to it: (loss, position, length of the other piece).  Backward
        A*: the forward score is the exact cost of what is left, so a step along the best path costs nothing and is
        taken at once; the queue holds turns only, by the score of the best whole path through them, and gives back
        whole paths in order.  Of equal ones that which was found first comes first.  Memory: a few numbers a
        character, and at most n * n turns.
        """
        most, ids, score = self.most, self.ids, self.score
        f, by, turns = [0.0] * (len(s) + 1), bytearray(len(s) + 1), [()] * (len(s) + 1)
        for j in range(1, len(s) + 1):
            found = []
            for l in range(1, min(most, j) + 1):
                k = ids.get(s[j - l : j])
                if k is not None:
                    found.append((f[j - l] + score[k], l))
                elif l == 1:
                    found.append((f[j - 1] + self.unknown, 1))
            best, length = max(found, key=lambda x: x[0])
            f[j], by[j], up = best, length, turns[j - length]
            if n > 1 and len(found) > 1:
                worst = up[-1][0] if len(up) >= n - 1 else np.inf
                own = [(best - x, j, l) for x, l in found if l != length and best - x < worst]
                if own:
                    up = tuple(sorted([*up, *own], key=lambda x: x[0])[: n - 1])
            turns[j] = up
        out, queue, made = [], [(0.0, 0, len(s), ())], 0
        while queue and len(out) < n:
            loss, _, start, taken = heapq.heappop(queue)  # the best path, turned off at ``taken``, is free up to start
            out.append((f[-1] - loss, self._ends(by, len(s), dict(taken))))
            for more, j, l in turns[start]:
                made += 1
                heapq.heappush(queue, (loss + more, made, j - l, (*taken, (j, l))))
        return out

    @staticmethod
    def _ends(by: bytearray, at: int, taken: dict[int, int]) -> tuple[int, ...]:
        out = []
        while at:
            out.append(at)
            at -= taken.get(at) or by[at]
        return tuple(reversed(out))

    def _edge(self, s: str, i: int, j: int) -> float:
        k = self.ids.get(s[i:j])
        return self.score[k] if k is not None else self.unknown if j == i + 1 else -np.inf

    def to_ids(self, s: str, ends) -> list[int]:
        out, at = [], 0
        for e in ends:
            k = self.ids.get(s[at:e])
            out += [k] if k is not None else [self.byte[b] for b in s[at:e].replace(OWN_MARK, MARK).encode()]
            at = e
        return out

    def alone(self, s: str) -> tuple[float, float, np.ndarray]:
        """Best score, what the second-best path loses, ids of the best path."""
        two = self.nbest(s, 2)
        return two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf, np.array(self.to_ids(s, two[0][1]), np.int64)

    # --- many units at once

    def many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``alone`` of each unit, those of alike length together: scores, losses, numbers of ids, and all ids."""
        size = np.array([len(u) for u in units])
        order = np.argsort(size, kind="stable")
        size = size[order]
        parts, a = [], 0
        while a < len(order):
            top = int(size[a])
            if top > _LONG:
                score, gap, ids = self.alone(units[order[a]])
                parts.append((np.array([score]), np.array([gap]), np.array([len(ids)]), ids))
                a += 1
                continue
            b = min(int(np.searchsorted(size, min(_LONG, top + (top > 12) * 4), "right")), a + max(1, 60_000 // max(8, top)))
            parts.append(self._together([units[r] for r in order[a:b]]))
            a = b
        if not parts:
            return np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        score, gap, many, flat = (np.concatenate([p[k] for p in parts]) for k in range(4))
        begin = np.cumsum(many) - many
        back = np.argsort(order, kind="stable")  # from the order by length to that of the units
        many, begin = many[back], begin[back]
        stop = np.cumsum(many)
        return score[back], gap[back], many, flat[np.repeat(begin - (stop - many), many) + np.arange(len(flat))].astype(np.int32)

    def _together(self, units: list[str]):
        n, size = len(units), np.array([len(u) for u in units])
        width = int(size.max()) if n else 0
        if not width:
            return np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(0, np.int64)
        points = np.zeros((n, width), np.uint64)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        at_row = np.repeat(np.arange(n), size)
        at_col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        points[at_row, at_col] = flat.astype(np.uint64) + np.uint64(1)
        edges: dict[tuple[int, int], np.ndarray] = {}
        ids: dict[tuple[int, int], np.ndarray] = {}
        base = np.uint64(0x9E3779B97F4A7C15)
        for i in range(width):
            h = np.zeros(n, np.uint64)
            for l in range(1, min(self.most, width - i) + 1):
                h = h * base + points[:, i + l - 1]
                inside = size >= i + l
                e, w = np.full(n, -np.inf), np.full(n, -1)
                if l in self.tables:
                    first, keys, score, which, deep = self.tables[l]
                    k = first[_slot(h)]
                    for step in range(deep):
                        hit = np.flatnonzero((keys[k + step] == h) & inside)
                        e[hit], w[hit] = score[k[hit] + step], which[k[hit] + step]
                if l == 1:
                    e = np.where((w < 0) & inside, self.unknown, e)
                if l == 1 or (w >= 0).any():
                    edges[i, l], ids[i, l] = e, w
        f = np.full((n, width + 1), -np.inf)
        f[:, 0] = 0
        by = np.zeros((n, width + 1), np.int64)
        rows = np.arange(n)
        for j in range(1, width + 1):
            for l in range(1, min(self.most, j) + 1):
                if (j - l, l) in edges:
                    x = f[:, j - l] + edges[j - l, l]
                    better = x >= f[:, j] if l == 1 else x > f[:, j]
                    f[better, j] = x[better]
                    by[better, j] = l
        b = np.full((n, width + 1), -np.inf)
        b[rows, size] = 0
        for i in range(width - 1, -1, -1):
            for l in range(1, min(self.most, width - i) + 1):
                if (i, l) in edges:
                    b[:, i] = np.maximum(b[:, i], edges[i, l] + b[:, i + l])
        # walk back along the best paths, marking their edges
        on = np.zeros((n, width + 1), np.int64)  # length of the best path's edge that starts here
        at = size.copy()
        while (at > 0).any():
            live = at > 0
            l = np.where(live, by[rows, at], 0)
            at = at - l
            on[rows[live], at[live]] = l[live]
        best = f[rows, size]
        second = np.full(n, -np.inf)
        for (i, l), e in edges.items():
            second = np.maximum(second, np.where(on[:, i] == l, -np.inf, f[:, i] + e + b[:, i + l]))
        gap = np.where(second > -np.inf, best - second, np.inf)
        chosen = np.full((n, width), -2)
        for (i, l), w in ids.items():
            rows_l = np.flatnonzero(on[:, i] == l)
            chosen[rows_l, i] = w[rows_l]
        used = chosen > -2
        flat, many = chosen[used], used.sum(1)
        odd = np.flatnonzero((chosen == -1).any(1))  # characters without a piece
        if len(odd):
            cut = np.split(flat, np.cumsum(many)[:-1])
            for r in odd:
                cut[r] = np.array(self.to_ids(units[r], np.flatnonzero(on[r]) + on[r][on[r] > 0]), np.int64)
            flat, many = np.concatenate(cut), np.array([len(c) for c in cut])
        return best, gap, many, flat

    # --- decoding

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        size = np.diff(self.raw_at)[ids]
        start = np.cumsum(size) - size
        return self.raw_bytes[np.repeat(self.raw_at[ids] - start, size) + np.arange(int(size.sum()))]

    def decode(self, ids) -> str:
        """The text of some ids: their bytes, without the space that encoding put first."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")[1:] if len(ids) else ""

    def encode(self, text: str) -> list[int]:
        return self.nbest_text(text, 1)[0][1]

    def nbest_text(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text by one search over its whole lattice."""
        if not text:
            return [(0.0, [])]
        s = lattice(" " + text)
        return [(score, self.to_ids(s, ends)) for score, ends in self.nbest(s, n)]


def lattice(raw: str) -> str:
    return raw.replace(MARK, OWN_MARK).replace(" ", MARK)


@lru_cache(2)
def load(path: str, unknown: float = 10.0) -> Pieces:
    return Pieces(path, unknown)


class Encoder:
    """Encodes chunks of texts, remembering units; the memory is emptied at ``most`` units."""

    def __init__(self, pieces: Pieces, n: int, most: int = 250_000):
        self.pieces, self.n, self.most = pieces, n, most
        self._empty()

    def _empty(self) -> None:
        self.h, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of units, and their numbers
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.lists: dict[int, list[tuple[float, list[int]]]] = {}

    def _learn(self, h: np.ndarray, units: list[str]) -> None:
        """Adds units with sorted hashes ``h``, none of which is known."""
        score, gap, many, flat = self.pieces.many(units)
        place = np.searchsorted(self.h, h)
        self.at = np.insert(self.at, place, len(self.score) + np.arange(len(units)))
        self.h = np.insert(self.h, place, h)
        self.score, self.gap = np.append(self.score, score), np.append(self.gap, gap)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(many))
        self.flat = np.append(self.flat, flat)

    def _others(self, u: int, unit: str) -> list[tuple[float, list[int]]]:
        """(loss, ids) of the next n - 1 paths of a unit."""
        if u not in self.lists:
            (best, _), *rest = self.pieces.nbest(unit, self.n)
            self.lists[u] = [(best - x, self.pieces.to_ids(unit, ends)) for x, ends in rest]
        return self.lists[u]

    def chunk(self, data: np.ndarray, at: np.ndarray, i: int, j: int):
        """Yields (ids, scores of the n best, decodes to itself, what the others replace) of texts i to j.

        What the k-th best path replaces: (place in ids, number of ids there, ids instead) of each unit that it
        cuts otherwise, from the first to the last.
        """
        low, size = data[at[i] : at[j]], np.diff(at[i : j + 1])
        edge = at[i:j] - at[i]
        full = size > 0
        raw = np.insert(low, edge[full], 32)
        new_edge = np.concatenate([[0], np.cumsum(size + full)])
        first = np.zeros(len(raw) + 1, bool)
        first[new_edge] = True
        space, feed = raw == 32, raw == 10
        first[1:-1] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        first[:-1] |= feed
        starts = np.flatnonzero(first[:-1])
        ends = np.append(starts[1:], len(raw))
        if not len(starts):
            for _ in range(j - i):
                yield np.zeros(0, np.int64), [0.0], True, []
            return
        h = word_hashes(raw, starts, ends)
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.score) > self.most:
            self._empty()
        k = np.minimum(np.searchsorted(self.h, distinct), max(0, len(self.h) - 1))
        fresh = np.flatnonzero(self.h[k] != distinct) if len(self.h) else np.arange(len(distinct))
        if len(fresh):
            begin, end, text = starts[where[fresh]].tolist(), ends[where[fresh]].tolist(), raw.tobytes()
            self._learn(distinct[fresh], [lattice(text[x:y].decode("utf-8", "replace")) for x, y in zip(begin, end, strict=True)])
        local = self.at[np.searchsorted(self.h, distinct)][inverse]
        score, gap, flat = self.score[local], self.gap[local], self.flat
        begin = self.begin[local]
        many = self.begin[local + 1] - begin
        stop = np.cumsum(many)
        ids = flat[np.repeat(begin - (stop - many), many) + np.arange(int(stop[-1]))].astype(np.int64)
        said = self.pieces.decode_bytes(ids)
        same_all = len(said) == len(raw) and bool((said == raw).all())
        bounds = np.searchsorted(starts, new_edge)
        stop = np.concatenate([[0], stop])
        for d in range(j - i):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                yield np.zeros(0, np.int64), [0.0], True, []
                continue
            own = ids[stop[a] : stop[b]]
            best = float(score[a:b].sum())
            paths: list[tuple[float, tuple]] = [(0.0, ())]
            if self.n > 1:
                g = gap[a:b]
                pick = np.argpartition(g, min(self.n - 2, len(g) - 1))[: self.n - 1] if len(g) > self.n - 1 else np.arange(len(g))
                for k in pick[np.argsort(g[pick], kind="stable")]:
                    if g[k] < np.inf:
                        unit = lattice(raw[starts[a + k] : ends[a + k]].tobytes().decode("utf-8", "replace"))
                        place = (int(stop[a + k] - stop[a]), int(many[a + k]))
                        other = [(y, ((*place, ids_y),)) for y, ids_y in self._others(int(local[a + k]), unit)]
                        paths = sorted(((x + y, c + d) for x, c in paths for y, d in [(0.0, ()), *other]), key=lambda p: p[0])[: self.n]
            ok = same_all or self.pieces.decode_bytes(own).tobytes() == raw[new_edge[d] : new_edge[d + 1]].tobytes()
            yield own, [best - x for x, _ in paths], ok, [sorted(c) for _, c in paths[1:]]


_CHANGE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str = MODEL, n: int = 3) -> DataFrame:
    """``docs`` (text and any other columns) with ids, scores (of the n best segmentations), others and decodes.

    ids: the best segmentation; others: of each further one what it replaces in ids, as (at, n, ids), from which
    ``nbest_ids`` makes it; decodes: whether ids decode to the text.  A null or empty text has no ids and one score,
    0.  Columns of these names are replaced.  Among equal segmentations the one with shorter pieces at its end is
    taken; repeated rows give repeated rows, an empty table an empty one.  A very long text, or one without any
    space, takes memory in proportion to its own length.  The pieces are broadcast (a vocabulary's size).  No shuffle.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("ids", "scores", "others", "decodes")
    at_text = docs.columns.index("text")
    shared = spark.sparkContext.broadcast(load(path))

    def run(batches):
        encoder = Encoder(shared.value, n)
        for batch in batches:
            data, at = buffers(batch.column(at_text))
            got = [x for i, j in chunks(at, 1 << 19) for x in encoder.chunk(data, at, i, j)]
            size = np.cumsum([0] + [len(x[0]) for x in got], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([x[0] for x in got]).astype(np.int32) if got else np.zeros(0, np.int32)))
            others = [[[{"at": a, "n": m, "ids": c} for a, m, c in p] for p in x[3]] for x in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([x[1] for x in got], pa.list_(pa.float64())), pa.array(others, pa.list_(pa.list_(_CHANGE))), pa.array([x[2] for x in got], pa.bool_())], names=[*batch.schema.names, "ids", "scores", "others", "decodes"])

    change = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    add = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("others", T.ArrayType(T.ArrayType(change))), T.StructField("decodes", T.BooleanType())]
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *add]))


def nbest_ids(k: int):
    """The ids of the k-th best segmentation (1: the best) of encoded rows, null where there is none."""
    if k == 1:
        return F.col("ids")
    change = f"""aggregate(others[{k - 2}], named_struct('at', 0, 'out', cast(array() as array<int>)), (s, c) ->
        named_struct('at', c.at + c.n, 'out', concat(s.out, slice(ids, s.at + 1, c.at - s.at), c.ids)),
        s -> concat(s.out, slice(ids, s.at + 1, size(ids) - s.at)))"""
    return F.expr(f"case when size(others) >= {k - 1} then {change} end")


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` (ids array<int> and any other columns) with the text of their ids; null ids give a null text."""
    rows = rows.drop("text")
    at_ids = rows.columns.index("ids")
    shared = rows.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else shared.value.decode(x) for x in batch.column(at_ids).to_pylist()], pa.string())], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the query, from encoded rows: ids as the SHA-256 of their decimal forms joined by spaces; of the
    second and third segmentation the number of pieces and what they replace, in the same form."""
    nth = [F.get("scores", F.lit(k)).alias(f"score_{k + 1}") for k in range(3)]
    said = F.transform(F.col("others"), lambda p: F.array_join(F.transform(p, lambda c: F.concat_ws(" ", c["at"], c["n"], F.array_join(c["ids"], " "))), ";"))
    more = [F.get(said, F.lit(k)).alias(f"change_{k + 2}") for k in range(2)]
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), *nth, *more, "decodes")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, encoded with the three best segmentations' scores, and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    return digest(encode(docs))
