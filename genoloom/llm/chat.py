"""Chat formatting: reply trees to conversations, with DataFrame operations only.

A *segment* is a run of replies without a branch.  Pointer-doubling self-joins find each message's segment and its
place there, in as many rounds as the logarithm of the longest run; the same over segments gives each leaf the sum of
its path's scores, in as many rounds as the logarithm of the deepest branching.  Leaves are ranked by that, and only
the paths of the best ``top_k`` of each tree are enumerated, by the same jumps, and formatted.  A very long text is a
value of one row; nothing here is an array of a path's segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import Scratch

#: Control strings of the template: prompt turn, its end, end of a role, assistant turn, its end.
INST, END_INST, TEXT, BOS, EOS = "[INST]", "[/INST]", "<|text|>", "<s>", "</s>"
CONTROLS = (INST, END_INST, TEXT, BOS, EOS)


def escape(text: Column) -> Column:
    r"""Doubles ``\`` and puts ``\.`` behind the first character of each control string, so none is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\.{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def paths(messages: DataFrame, top_k: int, scratch: Scratch) -> DataFrame:
    """(tree_id, path, rank, pos, role, text) of the messages on each tree's ``top_k`` best root-to-leaf paths.

    ``messages``: tree_id, node_id, parent_id, role, text, score.  A message whose parent is null or absent is a
    root; a null score counts 0; equal scores rank by leaf id.  Rows with a null tree_id or node_id and replies in
    a circle belong to no path; of rows with the same ids one stays, the least by role and text.
    """
    m = messages.select("tree_id", "node_id", "parent_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    m = m.where("tree_id is not null and node_id is not null")
    m = m.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("x")).select("tree_id", "node_id", "x.*")
    m = scratch.table(m, "messages")
    nodes = m.select("tree_id", "node_id", "parent_id", "score")
    parents = nodes.groupBy("tree_id", F.col("parent_id").alias("p")).agg(F.count("*").alias("replies"))
    known = nodes.select("tree_id", F.col("node_id").alias("p")).join(parents, ["tree_id", "p"], "inner")
    step = nodes.join(known.withColumnRenamed("p", "parent_id"), ["tree_id", "parent_id"], "left")
    start = F.coalesce(F.col("replies") != 1, F.lit(True))
    # at: the message that the pointer has reached; off: how many steps up; done: it is a segment's first
    ptr = step.select("tree_id", "node_id", F.when(start, F.col("node_id")).otherwise(F.col("parent_id")).alias("at"), F.when(start, 0).otherwise(1).cast("long").alias("off"), start.alias("done"), F.when(F.col("replies").isNotNull(), F.col("parent_id")).alias("parent_id"), "score")
    ptr, left, k = scratch.table(ptr, "ptr-0"), -1, 0
    settled, going = ptr.where("done"), ptr.where("not done")
    while (now := going.count()) not in (0, left):  # only those still on their way join again
        left, k = now, k + 1
        up = settled.union(going).select("tree_id", F.col("node_id").alias("at"), F.col("at").alias("at2"), F.col("off").alias("off2"), F.col("done").alias("done2"))
        ptr = going.join(up, ["tree_id", "at"]).select("tree_id", "node_id", F.col("at2").alias("at"), (F.col("off") + F.col("off2")).alias("off"), ((F.col("at") == F.col("at2")) | F.col("done2")).alias("done"), "parent_id", "score")
        ptr = scratch.table(ptr, f"ptr-{k}")
        settled, going = settled.union(ptr.where("done")), ptr.where("not done")
    ptr = settled
    score = ptr.groupBy("tree_id", F.col("at").alias("seg")).agg(F.sum("score").alias("score"), F.max_by("node_id", "off").alias("last"))
    heads = ptr.where("node_id = at").select("tree_id", F.col("node_id").alias("seg"), "parent_id")
    above = ptr.select("tree_id", F.col("node_id").alias("parent_id"), F.col("at").alias("up"))
    segs = scratch.table(heads.join(above, ["tree_id", "parent_id"], "left").join(score, ["tree_id", "seg"]).select("tree_id", "seg", "up", "score", "last"), "segments")
    leaf = segs.join(segs.select("tree_id", F.col("up").alias("seg")).where("seg is not null").distinct(), ["tree_id", "seg"], "left_anti").select("tree_id", F.col("seg").alias("at"), F.col("last").alias("leaf"))
    # total: scores from a segment up to before anc, its 2^k-th above, or to the root where there is none
    jump = scratch.table(segs.select("tree_id", "seg", F.col("up").alias("anc"), F.col("score").alias("total"), F.col("up").isNotNull().cast("long").alias("depth")), "jump-0")
    ranked, going, jumps, left = jump.where("anc is null"), jump.where("anc is not null"), [], -1
    while (now := going.count()) not in (0, left):  # what is left of circles never gets shorter
        left = now
        jumps.append(going.select("tree_id", F.col("seg").alias("at"), "anc"))
        ahead = ranked.union(going).select("tree_id", F.col("seg").alias("anc"), F.col("anc").alias("anc2"), F.col("total").alias("more"), F.col("depth").alias("higher"))
        jump = going.join(ahead, ["tree_id", "anc"]).select("tree_id", "seg", F.col("anc2").alias("anc"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("higher")).alias("depth"))
        jump = scratch.table(jump, f"jump-{len(jumps)}")
        ranked, going = ranked.union(jump.where("anc is null")), jump.where("anc is not null")
    full = ranked.select("tree_id", F.col("seg").alias("at"), F.col("total").alias("score"), "depth").join(leaf, ["tree_id", "at"])
    best = full.withColumn("rank", F.row_number().over(W.partitionBy("tree_id").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= top_k)
    at = best.select("tree_id", F.col("leaf").alias("leaf_id"), "rank", "score", "at", "depth")
    for k in reversed(range(len(jumps))):  # every segment above a chosen leaf is a sum of distinct jumps away
        at = scratch.table(at, f"chosen-{k}")
        up = at.join(jumps[k], ["tree_id", "at"]).select("tree_id", "leaf_id", "rank", "score", F.col("anc").alias("at"), (F.col("depth") - 2**k).alias("depth"))
        at = at.union(up)
    rows = at.join(ptr.select("tree_id", "at", "node_id", "off"), ["tree_id", "at"])
    return rows.join(m.drop("score", "parent_id"), ["tree_id", "node_id"]).select("tree_id", "leaf_id", "rank", "score", F.struct("depth", "off").alias("pos"), "role", "text")


def format_trees(messages: DataFrame, top_k: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """One row for each chosen path: tree_id, leaf_id, rank, score, n_turns, formatted, loss_spans.

    A prompt turn is ``[INST]role<|text|>text[/INST]``, an assistant turn ``<s>text</s>``; control strings inside
    roles and texts are escaped reversibly.  A null role or text is empty.  loss_spans: (start, length) in code
    points of each assistant text as it stands in ``formatted``.
    """
    rows = paths(messages, top_k, scratch or Scratch(messages.sparkSession))
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    own = F.coalesce(F.col("role") == "assistant", F.lit(False))
    rows = rows.withColumn("own", own).withColumn("body", text).withColumn("piece", F.when(own, F.concat(F.lit(BOS), text, F.lit(EOS))).otherwise(F.concat(F.lit(INST), role, F.lit(TEXT), text, F.lit(END_INST))))
    before = W.partitionBy("tree_id", "leaf_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + len(BOS))
    turns = rows.groupBy("tree_id", "leaf_id", "rank", "score").agg(F.array_sort(F.collect_list(F.struct("pos", "piece", "own", "start", F.char_length("body").cast("long").alias("length")))).alias("t"))
    return turns.select("tree_id", "leaf_id", "rank", "score", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.transform(F.filter("t", lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pattern = F.lit(r"(?s)(\[INST\]|<s>)(.*?)(?:\[/INST\]|</s>)")
    turns = F.arrays_zip(F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("mark"), F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("body"))

    def turn(t: Column) -> Column:
        cut = F.split(t["body"], r"<\|text\|>", 2)
        own = t["mark"] == BOS
        return F.struct(F.when(own, "assistant").otherwise(unescape(cut[0])).alias("role"), unescape(F.when(own, t["body"]).otherwise(cut[1])).alias("text"))

    return F.transform(turns, turn)


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as unbranched trees; equal turns go by role and text.  A null conv_id makes no conversation."""
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("tree_id"), nth.alias("node_id"), "role", "text")
    return rows.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one that holds control strings, formatted and read back from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    out = format_trees(conversations_as_trees(rows.union(extra)))
    out = out.withColumn("turns", parse(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return out.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


_E = "replace({x}, '\\', '\\\\')"
for _c in CONTROLS:
    _E = f"replace({_E}, '{_c}', '{_c[0]}\\.{_c[1:]}')"
OP1_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' then length({_E.format(x='text')}) + 7
    else length({_E.format(x='text')}) + length({_E.format(x='role')}) + 21 end) as bigint) as formatted_chars
from c group by conv_id
"""
