"""Benchmark decontamination: windows of typed templates, hash-joined, with consistent slots.

Numbers, names and units become typed placeholders, so that a question with other numbers or names keeps its
template.  Windows of ``width`` template tokens are hashed and looked up in the benchmark's; so are windows of plain
words, for texts whose names or case tell nothing, and windows of a second reading, which takes words that begin a
sentence for names too.  Windows of both sides are tables, joined by hash.  The values in the item's slots must map
to the document's one to one: the same value always to the same, and no two to one.  What is left covers a share of
the item.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, lean, small_batches
from .text import buffers, chunks, mix, powers, word_hashes

# Units of measure, singular and plural, and currencies.
UNITS = """
mm cm dm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre
kilometres mg g kg t gram grams kilogram kilograms ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml cl l
liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks
month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar psi degree degrees celsius fahrenheit
percent dollar dollars cent cents euro euros eur usd gbp yen kb mb gb tb bit bits byte bytes mph kmh kph
""".split()
LITERAL, NUMBER, NAME, UNIT = range(4)
_MARK = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ALNUM[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b'.!?:;\n\r"()')] = True


def _hash_list(names) -> np.ndarray:
    raw = " ".join(names).encode()
    edge = np.cumsum([0] + [len(w) + 1 for w in names])
    low = np.frombuffer(raw, np.uint8)
    return np.sort(word_hashes(low, edge[:-1], edge[1:] - 1))


_UNIT_HASHES = _hash_list(UNITS)


def tokens(data: np.ndarray, at: np.ndarray, i: int, j: int):
    """Of texts i to j, twice: each token's text, kind, and hash; runs of names count as one.

    A token is a run of letters and digits, with points and commas between digits.  A number starts with a digit; a
    unit stands right behind a number; a name begins with a capital, has few others, and does not begin a sentence.
    The second reading also takes words that begin a sentence, and capitalised ones of two letters, for names.
    """
    raw = data[at[i] : at[j]]
    edge = at[i : j + 1] - at[i]
    n = len(raw)
    if not n:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64))] * 2
    low = raw.copy()
    capital = (raw >= 65) & (raw <= 90)
    low[capital] += 32
    latin = np.zeros(n, bool)
    latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[latin] += 32
    capital[:-1] |= latin[1:]
    word = _ALNUM[raw]
    wide = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80)) if n > 2 else np.zeros(0, int)
    for k in range(3):
        word[wide + k] = False
    thin = np.flatnonzero(raw[:-1] == 0xC2)
    word[thin] = word[thin + 1] = False
    digit = _DIGIT[raw]
    if n > 2:
        word[1:-1] |= digit[:-2] & digit[2:] & ((raw[1:-1] == 44) | (raw[1:-1] == 46))
    pad = np.zeros(n + 2, bool)
    pad[1:-1] = word
    starts = np.flatnonzero(pad[1:-1] & ~pad[:-2])
    ends = np.flatnonzero(pad[1:-1] & ~pad[2:]) + 1
    inner = edge[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    cut = inner[word[inner] & word[inner - 1]]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64))] * 2
    doc = np.searchsorted(edge, starts, "right") - 1
    h = word_hashes(low, starts, ends)
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    first = np.ones(len(starts), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    kind = np.zeros(len(starts), np.int8)
    capitals = np.concatenate([[0], np.cumsum(capital)])
    shouted = 2 * (capitals[ends] - capitals[starts]) >= ends - starts  # a text in capitals has no names to see
    strict = capital[starts] & ~first & ~shouted
    kind[digit[starts]] = NUMBER
    after = np.flatnonzero((kind[:-1] == NUMBER) & ~first[1:] & (kind[1:] != NUMBER)) + 1
    if len(after):
        k = np.minimum(np.searchsorted(_UNIT_HASHES, h[after]), len(_UNIT_HASHES) - 1)
        kind[after[_UNIT_HASHES[k] == h[after]]] = UNIT
    eager = capital[starts] & ((capitals[ends] - capitals[starts] <= 1) | ~shouted)
    return [_named(doc, np.where((kind == LITERAL) & names, NAME, kind).astype(np.int8), h) for names in (strict, eager)]


def _named(doc: np.ndarray, kind: np.ndarray, h: np.ndarray):
    """A run of names is one token, whose hash is that of all its words."""
    name = kind == NAME
    goes_on = np.zeros(len(doc), bool)
    goes_on[1:] = name[1:] & name[:-1] & (doc[1:] == doc[:-1])
    if goes_on.any():
        head = np.flatnonzero(~goes_on)
        length = np.diff(np.append(head, len(doc)))
        place = np.arange(len(doc)) - np.repeat(head, length)
        joined = np.add.reduceat(mix(h + place.astype(np.uint64)), head)
        h = np.where(length > 1, joined, h[head])
        doc, kind = doc[head], kind[head]
    return doc.astype(np.int64), kind, h


def windows(view: int, doc: np.ndarray, kind: np.ndarray, h: np.ndarray, width: int):
    """Start and hash of each template window and each plain window of one reading.

    A template window has a slot (else the plain one says as much) and a literal token, in the second reading at least
    half of them; the second has no plain windows, which are those of the first.
    """
    n = len(h) - width + 1
    if n <= 0:
        return []
    one = doc[:n] == doc[width - 1 :]
    template = np.where(kind == LITERAL, h, _MARK[kind])
    slots = np.concatenate([[0], np.cumsum(kind != LITERAL)])
    many = slots[width:] - slots[:-width]
    most = width // 2 if view else width - 1
    up, down = powers(len(h) + 1)
    out = []
    for x, keep, salt in ((template, one & (many > 0) & (many <= most), 1 + view), (h, one, 3))[: 2 - view]:
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])])
        at = np.flatnonzero(keep)
        out.append((at, mix((run[at + width] - run[at]) * down[at] + np.uint64(salt * 1000 + width))))
    return out


# --- tables of windows ------------------------------------------------------------------------------------------

_WINDOW = "h long, item long, item_id long, view int, pos int, width int, size int, literals int, kinds binary, mine binary"


def _item_windows(width: int, shortest: int):
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            cols: list[list] = [[] for _ in range(10)]
            for d, (item, item_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for view, (doc, kind, value) in enumerate(tokens(data, at, d, d + 1)):
                    if len(value) < shortest:
                        continue
                    w = min(width, len(value))
                    for start, h in windows(view, doc, kind, value, w):
                        for p, x in zip(start.tolist(), h.view(np.int64).tolist(), strict=True):
                            row = (x, item, item_id, view, p, w, len(value), int((kind == LITERAL).sum()), kind[p : p + w].tobytes(), value[p : p + w].tobytes())
                            for c, v in zip(cols, row, strict=True):
                                c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _WINDOW.split(", ")])

    return run


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(s)).astype(np.int64) & ((1 << bits) - 1) for s in (0, 20, 34)]


def _filter_blocks(bits: int):
    """Blocks of 2 ** 13 bits of a filter with the hashes of each batch."""

    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            place = np.unique(np.concatenate(_probes(h, bits)))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(place >> 13) > 0, [True]]))
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                block = np.zeros(1 << 13, bool)
                block[place[a:b] & 8191] = True
                rows.append((int(place[a] >> 13), np.packbits(block).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["k", "b"])

    return run


def window_filter(table: DataFrame, most_bits: int = 28) -> tuple[int, np.ndarray]:
    """A Bloom filter of the table's hashes h: 64 bits a row, at most 2 ** ``most_bits`` in all (32 MB), the bound of
    what is broadcast; a fuller filter only lets more windows through to the join."""
    bits = min(most_bits, max(16, (64 * table.count()).bit_length()))
    found = np.zeros(1 << (bits - 3), np.uint8)
    blocks = table.select("h").mapInArrow(_filter_blocks(bits), "k int, b binary").distinct()
    for r in blocks.toLocalIterator():
        found[r["k"] << 10 : (r["k"] + 1) << 10] |= np.frombuffer(r["b"], np.uint8)
    return bits, found


def _doc_windows(shared):
    """(windows that may be an item's) of each document: its key, the window's hash, place and tokens."""

    def run(batches):
        widths, bits, found = shared.value
        for batch in batches:
            data, at = buffers(batch.column(3))
            rows, hs, places, theirs = [], [], [], []
            for i, j in chunks(at):
                for view, (doc, kind, value) in enumerate(tokens(data, at, i, j)):
                    for width in widths:
                        for start, h in windows(view, doc, kind, value, width):
                            for probe in (0, 20, 34):
                                k = (h >> np.uint64(probe)).astype(np.int64) & ((1 << bits) - 1)
                                hit = np.flatnonzero((found[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1)
                                start, h = start[hit], h[hit]
                            rows.append(i + doc[start])
                            hs.append(h.view(np.int64))
                            places.append(start - np.searchsorted(doc, doc[start]))
                            theirs += [value[p : p + width].tobytes() for p in start]
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in range(3)), pa.array(np.concatenate(hs) if hs else np.zeros(0, np.int64)), pa.array(place, pa.int32()), pa.array(theirs, pa.binary())], names=["doc_id", "k1", "k2", "h", "at", "theirs"])

    return run


def judge(rows: list[tuple]) -> tuple[set, int, int]:
    """Item's tokens covered, those of them in changed slots, and those literal or unchanged, by windows that agree.

    rows: (pos, kinds, mine, theirs) of windows of one text and one item.  Slots vote: a value of the item maps to
    the document's value that most windows give it, one to one within a kind; windows that hold another value go.
    """
    votes: dict[tuple, int] = defaultdict(int)
    for pos, kinds, mine, theirs in rows:
        for k, a, b in zip(kinds, mine, theirs, strict=True):
            if k != LITERAL:
                votes[k, a, b] += 1
    to, back = {}, {}
    for k, a, b in sorted(votes, key=lambda v: (-votes[v], v[1] != v[2], v)):
        if (k, a) not in to and (k, b) not in back:
            to[k, a], back[k, b] = b, a
    covered, changed, said = set(), set(), set()
    for pos, kinds, mine, theirs in rows:
        if all(k == LITERAL or to.get((k, a)) == b for k, a, b in zip(kinds, mine, theirs, strict=True)):
            for p, (k, a, b) in enumerate(zip(kinds, mine, theirs, strict=True), pos):
                covered.add(p)
                (said if k == LITERAL or a == b else changed).add(p)
    return covered, len(changed), len(said | (covered - changed))


def _judged(least_share: float, least_tokens: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, tuple(k), tuple(np.frombuffer(m, np.uint64).tolist()), tuple(np.frombuffer(t, np.uint64).tolist())) for p, k, m, t in zip(pdf["pos"], pdf["kinds"], pdf["mine"], pdf["theirs"], strict=True)]
        covered, changed, said = judge(sorted(set(rows)))
        size, literals = int(pdf["size"].iloc[0]), int(pdf["literals"].iloc[0])
        n = len(covered)
        if (n >= least_share * size or n >= least_tokens) and said >= min(4, -(-size // 2), max(1, literals)):
            return pd.DataFrame({"k1": pdf["k1"][:1], "k2": pdf["k2"][:1], "item_id": pdf["item_id"][:1], "covered": [n / size], "n_changed": [changed]})
        return pd.DataFrame({"k1": [], "k2": [], "item_id": [], "covered": [], "n_changed": []})

    return run


OPTIONS = {"width": 8, "shortest": 3, "least_share": 0.4, "least_tokens": 20}


def _text_keys():
    return F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")


def _found(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, o: dict) -> tuple[DataFrame, DataFrame]:
    """Windows of documents that may be an item's (doc_id, k1, k2, ...), and (k1, k2, item_id, covered, n_changed)."""
    items = benchmark.where("item_id is not null and length(text) > 0").select(F.col("item_id").cast("long"), "text").distinct()
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    table = scratch.table(items.mapInArrow(lean(_item_windows(o["width"], o["shortest"])), _WINDOW), "windows")
    widths = [r[0] for r in table.select("width").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast((sorted(widths), *window_filter(table)))
    rows = docs.where("length(text) > 0").select(F.col("doc_id").cast("long"), *_text_keys(), "text")
    hits = scratch.table(rows.mapInArrow(lean(_doc_windows(shared)), "doc_id long, k1 long, k2 long, h long, at int, theirs binary"), "hits")
    # copies of a text count once from here on
    pairs = hits.select("k1", "k2", "h", "at", "theirs").distinct().join(table, "h").where(F.length("theirs") == 8 * F.col("width"))
    judged = pairs.groupBy("k1", "k2", "item", "view").applyInPandas(_judged(o["least_share"], o["least_tokens"]), "k1 long, k2 long, item_id long, covered double, n_changed long")
    return hits, judged


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """doc_id, item_id, covered, n_changed of each document (doc_id, text) that holds an item (item_id, text).

    covered: share of the item's tokens in matching windows; n_changed: slots with another number, name or unit (0: a
    copy).  A pair is a leak from ``least_share`` of the item or ``least_tokens`` tokens on, if enough of them are
    literal or unchanged (``min(4, half of the item, its literals)``).  Items under ``shortest`` tokens are too short
    to tell and are not searched; those under ``width`` match as a whole.  Null or empty texts and null ids match
    nothing; of repeated rows one pair is left; of items with one id each text is searched, the best cover stays
    (ties: the fewer changes).  Very long texts are searched whole; an empty table on either side gives none.
    Windows of both sides are tables, joined by hash; of documents only windows that a filter of bounded size lets
    by.  Texts are known by 128 bits of hash.
    """
    o = OPTIONS | options
    small_batches(docs.sparkSession)
    hits, judged = _found(docs.where("doc_id is not null"), benchmark, scratch or Scratch(docs.sparkSession), o)
    best = F.max(F.struct("covered", (-F.col("n_changed")).alias("same"))).alias("x")
    of = hits.select("doc_id", "k1", "k2").distinct().join(judged, ["k1", "k2"])
    return of.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.covered", (-F.col("x.same")).alias("n_changed"))


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """``docs`` (text and any other columns) without the rows that hold a benchmark item; the rest as they are.

    Rows are judged by their texts alone, so a null doc_id is searched too; see ``leaks``.
    """
    o = OPTIONS | options
    small_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession)
    _, judged = _found(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), benchmark, scratch, o)
    gone = scratch.table(judged.select("k1", "k2").distinct(), "leaked")
    keys = [F.coalesce(k, F.lit(0)) for k in (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))]
    return scratch.without(docs, gone, dict(zip(("k1", "k2"), keys, strict=True)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
