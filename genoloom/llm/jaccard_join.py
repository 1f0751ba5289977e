"""N-gram Jaccard join: a grouped prefix join over word shingles.

Documents that share a similarity of ``threshold`` share a shingle within their *prefixes*, the first
n - ceil(threshold * n) + 1 shingles of each in one order of all shingles.  The order here: shingles
of more than ``hot_df`` documents last, else by hash.  Steps:

1. one pass over the texts gives each document its sorted shingle hashes (48 bits); equal sets are one class;
2. shingles are counted over all documents in ranges of their hashes; those above ``hot_df`` are the hot ones.
   Their table is broadcast; the bound doubles until at most ``hot_limit`` are left, so its size is bounded.  A map of
   2 ** LIVE bits, whatever the data, says where a shingle of two documents may be: others pair nothing up;
3. classes with the same cold prefix and size collapse into one group; an index from shingle to groups gives
   group pairs of fitting sizes, and those are filtered by how much of the prefix they share, which bounds the
   overlap from above exactly.  A list of the index holds at most ``hot_df`` documents;
4. group pairs expand into their members, which are verified on whole sets;
5. classes whose cold shingles do not fill a prefix (copies and boilerplate in large numbers) share hot ones:
   they are gathered by common hot prefix shingles, cut into blocks of bounded size, and each pair of blocks is
   verified by a matrix product that gives back a spanning forest, not all pairs.

Links become components by alternating stars.  No step drops a pair of different texts.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, give_back, lean
from .text import buffers, chunks, mix, shingle_hashes, word_hashes, words

LIVE = 26
_SETS = "doc_id long, n long, sig long, top long, h binary"


def _pack(h: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, 6 bytes each."""
    return np.ascontiguousarray((h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(b) -> np.ndarray:
    b = np.frombuffer(b, np.uint8)
    x = np.zeros((len(b) // 6, 8), np.uint8)
    x[:, :6] = b.reshape(-1, 6)
    return x.view("<u8").reshape(-1)


def _sets(width: int):
    def run(batches):
        for batch in batches:
            ids, (data, at) = batch.column(0), buffers(batch.column(1))
            n, sig, blobs = [], [], []
            for i, j in chunks(at):
                starts, ends, doc, low = words(data, at, i, j)
                for h in shingle_hashes(word_hashes(low, starts, ends), doc, j - i, width):
                    n.append(len(h))
                    sig.append(int((np.bitwise_xor.reduce(h) ^ mix(h * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)).astype(np.int64)) if len(h) else 0)
                    blobs.append(_pack(h))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(np.zeros(len(n), np.int64)), pa.array(blobs, pa.binary())], names=["doc_id", "n", "sig", "top", "h"])

    return run


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, sig, h): number of distinct shingles, a hash of their set, and the sorted hashes."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_sets(width)), _SETS).drop("top")


def _ranges(bits: int):
    """Cuts each batch's hashes at their upper ``bits``; the next 32 are what is counted."""

    def run(batches):
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            _, at, data = column.buffers()
            at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
            h = np.sort(_unpack(np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]))
            top = (h >> np.uint64(48 - bits)).astype(np.int64)
            low = (h >> np.uint64(16 - bits)).astype(np.uint32)
            cuts = np.searchsorted(top, np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([low[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())], names=["part", "b"])

    return run


def _frequent(bits: int, least: int):
    """Of each range the hashes of more than ``least`` documents, and (df -1) its slice of the map of live ones."""

    def run(batches):
        held: dict[int, list[bytes]] = {}

        def counted(part):
            x = np.sort(np.frombuffer(b"".join(held.pop(part)), np.uint32))
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
            many, x = np.diff(edge), x[edge[:-1]]
            live = np.zeros(1 << (LIVE - bits), bool)
            live[x[many > 1] >> np.uint32(32 - LIVE + bits)] = True
            keep = many > least
            h = (np.int64(part) << 32) | x[keep].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h, part)), pa.array(np.append(many[keep], -1), pa.int64()), pa.array([None] * len(h) + [np.packbits(live).tobytes()], pa.binary())], names=["h", "df", "live"])

        for batch in batches:
            for part, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part not in held:  # rows come sorted by part
                    for old in list(held):
                        yield counted(old)
                held.setdefault(part, []).append(b)
        for old in list(held):
            yield counted(old)

    return run


def hot_shingles(sets: DataFrame, scratch: Scratch, hot_df: int, hot_limit: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Sorted prefixes (bits + 32 bits) of the hashes in more than ``hot_df`` documents, how many bits to shift, and
    the map of live hashes by their first LIVE bits."""
    bits = min(14, max(6, int(sets.rdd.getNumPartitions()).bit_length() + 2))
    parts = sets.select("h").where("n > 0").mapInArrow(lean(_ranges(bits)), "part int, b binary")
    found = parts.repartition(1 << max(3, bits - 3), "part").sortWithinPartitions("part").mapInArrow(lean(_frequent(bits, hot_df)), "h long, df long, live binary")
    found = scratch.table(found, "hot")
    least = hot_df
    while found.where(F.col("df") > least).count() > hot_limit:
        least *= 2
    live = np.zeros((1 << bits, 1 << (LIVE - bits - 3)), np.uint8)
    for row in found.where("df = -1").select("h", "live").toPandas().itertuples():
        live[row.h] = np.frombuffer(row.live, np.uint8)
    return np.sort(found.where(F.col("df") > least).select("h").toPandas()["h"].to_numpy(np.int64)), 16 - bits, live.ravel()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0] + [len(x) for x in parts], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _prefixes(shared, shift: int, num: int, den: int):
    """Of the cold prefix in hash order the live shingles, its size p and last hash, and the hot shingles that a prefix
    which the cold ones do not fill goes on with."""

    def run(batches):
        table, live = shared.value
        for batch in batches:
            cold_all, size, hot_all, last = [], [], [], []
            for n, blob in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                h = _unpack(blob.as_buffer())
                p = n - -(-num * n // den) + 1 if n else 0
                is_hot = np.zeros(len(h), bool)
                if len(table) and len(h):
                    key = (h >> np.uint64(shift)).astype(np.int64)
                    is_hot = table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key
                cold = h[~is_hot][:p]
                size.append(len(cold))
                last.append(int(cold[-1]) if p and len(cold) == p else (1 << 62))
                at = (cold >> np.uint64(48 - LIVE)).astype(np.int64)
                cold_all.append(cold[(live[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1].astype(np.int64))
                hot_all.append(h[is_hot][: p - len(cold)].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int64()), pa.array(last, pa.int64()), _lists(cold_all), _lists(hot_all)], names=["doc_id", "n", "sig", "p", "last", "cold", "hot"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _verify_pairs(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = [_linked(_unpack(x), _unpack(y), num, den) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return run


def forest(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each row's least id reachable by true cells of the symmetric matrix ``near``."""
    np.fill_diagonal(near, True)
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.where(near, label[None, :], top).min(1)
        if (new == label).all():
            return label
        label = new


def _verify_block(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("a").sort_values("a")
        ids, sets = pdf["a"].to_numpy(np.int64), [_unpack(b) for b in pdf["h"]]
        size = np.array([len(x) for x in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), size)
        _, col, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(many > 1) - 1  # a shingle of one document is in no intersection
        keep = many[col] > 1
        row, col = row[keep], rank[col[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
            a, b = np.searchsorted(col, [at, at + 4096])
            m = np.zeros((len(ids), min(4096, int(col[-1]) + 1 - at)), np.float32)
            m[row[a:b], col[a:b] - at] = 1
            both += m @ m.T
        both = np.rint(both).astype(np.int64)
        label = forest(den * both >= num * (size[:, None] + size[None, :] - both), ids)
        away = label != ids
        return pd.DataFrame({"a": ids[away], "b": label[away]})

    return run


def _only(sets: DataFrame, ids: DataFrame, slots: int = 1 << 18) -> DataFrame:
    """The rows of ``sets`` (doc_id, h) whose doc_id is in ``ids`` (a), once each.

    A table of at most ``slots`` hash values, whatever the size of ``ids``, is broadcast first, so that most sets
    that nobody asked for are not shuffled; the join on doc_id decides.
    """
    ids = ids.select(F.col("a").alias("doc_id")).distinct()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    near = sets.withColumn("slot", slot).join(F.broadcast(ids.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")
    return near.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def jaccard_join(docs: DataFrame, *, width: int = 3, threshold: tuple[int, int] = (90, 100), hot_df: int = 32, hot_limit: int = 2_000_000, block: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when den * |intersection| >= num * |union| for ``threshold`` = (num, den); a component is
    named by its least doc_id.  A null or empty text, or one of white space, has no shingles and links with nothing:
    it is its own component.  A text shorter than ``width`` words has one shingle.  A null doc_id is dropped from
    links and keeps a null component.  Repeated rows give repeated rows; an empty table an empty one.
    """
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark)
    num, den = threshold
    sets = scratch.table(shingle_sets(docs, width), "sets")
    hot, shift, live = hot_shingles(sets, scratch, hot_df, hot_limit)
    scratch.tidy()
    shared = spark.sparkContext.broadcast((hot, live))
    del live
    give_back()
    every = sets.mapInArrow(lean(_prefixes(shared, shift, num, den)), "doc_id long, n long, sig long, p long, last long, cold array<long>, hot array<long>")
    every = scratch.table(every, "prefixes")
    rows = every.where("n > 0 and doc_id is not null")
    classes = rows.groupBy("sig", "n").agg(F.min("doc_id").alias("rep"))
    # Equal sets have equal prefixes, so this takes copies and classes of the same prefix and size together.
    grouped = rows.withColumn("gid", F.xxhash64("cold", "n", "p"))
    groups = grouped.groupBy("gid").agg(F.first("n").cast("int").alias("n"), F.first("cold").alias("cold"))
    index = groups.select("gid", "n", F.explode("cold").alias("t"))
    lists = index.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "gid"))).alias("m")).where(F.size("m") > 1)
    pair = F.expr(f"""flatten(transform(m, (x, i) -> transform(
        filter(slice(m, i + 2, size(m)), y -> {den}L * x.n >= {num}L * y.n),
        y -> struct(x.gid as g, y.gid as g2))))""")
    pairs = lists.select(F.explode(pair).alias("x")).select("x.*").groupBy("g", "g2").agg(F.count("*").alias("c"))
    # What is left behind the region that both prefixes cover: it ends where the first of them does.
    ends = grouped.groupBy("gid").agg(F.first("n").alias("n"), (F.first("n") - F.first("p")).alias("rest"), F.min("last").alias("lo"), F.max("last").alias("hi"))
    first = ends.select(F.col("gid").alias("g"), F.col("n").alias("n1"), F.col("rest").alias("r1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    second = ends.select(F.col("gid").alias("g2"), F.col("n").alias("n2"), F.col("rest").alias("r2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    rest = "case when hi1 <= lo2 then r1 when hi2 <= lo1 then r2 else greatest(r1, r2) end"
    # den * o >= num * (n1 + n2 - o) needs o >= num * (n1 + n2) / (num + den); o <= c + what is left of either.
    pairs = pairs.join(first, "g").join(second, "g2").where(F.expr(f"({num} + {den}) * (c + {rest}) >= {num} * (n1 + n2)")).select("g", "g2")
    members = grouped.groupBy("gid", "sig", "n").agg(F.min("doc_id").alias("rep"), F.first(F.size("cold") > 0).alias("some"))
    sizes = members.groupBy("gid").agg(F.count("*").alias("k"), F.min("rep").alias("lead"))
    # Groups of several classes: their members meet in blocks below.  Pairs of groups expand here.
    found = pairs.join(members.select(F.col("gid").alias("g"), F.col("rep").alias("a")), "g").join(members.select(F.col("gid").alias("g2"), F.col("rep").alias("b")), "g2").select("a", "b")
    found = scratch.table(found, "candidates")
    # Classes that share hot prefix shingles, or a group: gathered, then verified block by block.
    crowd = rows.where("size(hot) > 0").groupBy("sig", "n", "hot").agg(F.min("doc_id").alias("a")).select("a", F.explode("hot").alias("t"))
    star = crowd.groupBy("t").agg(F.min("a").alias("b")).join(crowd, "t").select("a", "b")
    same = members.where("some").join(sizes.where("k > 1"), "gid").select(F.col("rep").alias("a"), F.col("lead").alias("b"))
    gathered = components(star.union(same), scratch, "crowd").withColumnRenamed("node", "a").withColumnRenamed("component", "c")
    h_want = scratch.table(_only(sets.select("doc_id", "h"), found.select("a").union(found.select("b")).union(gathered.select("a"))), "wanted")
    scratch.drop("sets")
    first = h_want.select(F.col("doc_id").alias("a"), F.col("h").alias("ha"))
    second = h_want.select(F.col("doc_id").alias("b"), F.col("h").alias("hb"))
    links = found.join(first, "a").join(second, "b").select("a", "b", "ha", "hb").mapInArrow(lean(_verify_pairs(num, den)), "a long, b long")
    many = gathered.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    placed = gathered.join(many, "c").withColumn("i", F.pmod(F.xxhash64("a"), F.col("nb")).cast("int"))
    met = placed.join(h_want.withColumnRenamed("doc_id", "a"), "a").select("c", "a", "h", "nb", "i", F.explode(F.expr("sequence(0, nb - 1)")).alias("j"))
    blocks = met.select("c", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "a", "h")
    links = links.union(blocks.groupBy("c", "i", "j").applyInPandas(_verify_block(num, den), "a long, b long"))
    label = components(scratch.table(links, "links"), scratch, "cc")
    # each document gets its class's representative's component
    named = classes.join(label, classes.rep == label.node, "left").select("sig", "n", F.coalesce("component", "rep").alias("component_id"))
    return every.join(named, ["sig", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: 3-word shingles, Jaccard similarity 0.9."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: By all pairs that share a shingle, and all that a document reaches: for the small sizes.
OP4_SQL = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
o as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as materialized (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
r as (select doc_id as a, doc_id as b from n union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as c from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.c, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id
"""
