"""The queries of the core library, by name, and SQL for each that SQL can express.

The tables at hand are a shop's, not a laboratory's, so each query says what stands for what.  Doubles are rounded
alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import cauchy_statistic, norm_sf
from ..functions.stats import z_from_p as signed_z
from ..operators import combine, diagnose, expression, graph_latent, gss, intervals, ld, neighbors, ranks, regress, sumstats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Cauchy combination: annotation is an event's type or user, p falls with its value ---------------------------

_OUT = """
with e as ({e}),
q as (select annotation, count(*) as n, quantile_cont(-log10(p), 0.5) as m,
  quantile_cont(-log10(p), 0.75) - quantile_cont(-log10(p), 0.25) as iqr from e group by annotation),
t as (select e.annotation, p, n, -log10(p) >= m + 3 * iqr as far from e join q using (annotation)),
o as (select annotation, count(*) filter (far) as k from t group by annotation),
kept as (select annotation, p, not (far and k > 0 and k < greatest(0.01 * n, 20)) as keep from t join o using (annotation)),
a as (select annotation, coalesce(avg(case when p < 1e-15 then 1 / p / pi() else tan((0.5 - p) * pi()) end) filter (keep), 0) as t,
  median(p) as md from kept group by annotation)
select annotation, round(-log10(case when t > 1e15 then 1 / t / pi() else atan2(1, t) / pi() end), 6) as logp_cauchy,
  round(md, 9) as p_median from a
"""


def _of_events(group):
    return _OUT.format(e=f"select {group} as annotation, exp(-value / 50) as p from events where {group} is not null")


def _events(spark, sf_dir, group):
    return _t(spark, sf_dir, "events").select(F.col(group).alias("annotation"), F.exp(-F.col("value") / 50).alias("p"))


def _rounded_cauchy(rows):
    out = combine.cauchy_combination(rows)
    return out.select("annotation", F.round(-F.log10("p_cauchy"), 6).alias("logp_cauchy"), F.round("p_median", 9).alias("p_median"))


@query(_of_events("event_type"))
def cauchy_region(spark, sf_dir):
    return _rounded_cauchy(_events(spark, sf_dir, "event_type"))


@query(_of_events("user_id"))
def cauchy_by_user(spark, sf_dir):
    return _rounded_cauchy(_events(spark, sf_dir, "user_id"))


@query("""select event_type as annotation, round(log10(avg(case when p < 1e-15 then 1 / p / pi() else tan((0.5 - p) * pi()) end)), 6) as log_t
from (select event_type, exp(-abs(value) - 0.001) as p from events) group by event_type""")
def cauchy_tiny_p(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_type", F.exp(-F.abs("value") - 0.001).alias("p"))
    return rows.groupBy(F.col("event_type").alias("annotation")).agg(F.round(F.log10(cauchy_statistic(F.col("p"))), 6).alias("log_t"))


@query("""select event_type as annotation, count(*) as n, round(quantile_cont(value, 0.25), 6) as q25, round(median(value), 6) as q50,
  round(quantile_cont(value, 0.75), 6) as q75 from events group by event_type""")
def order_statistics(spark, sf_dir):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("annotation")).agg(F.count("*").alias("n"), q.alias("q"))
    return out.select("annotation", "n", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("q25", "q50", "q75"))])


# --- summary statistics: a variant is a part, with sums over its line items ---------------------------------------

_GWAS = """
g as (select l_partkey as part, avg(l_discount) * 5 as frq, round(sum(l_quantity), 6) as n, 1 - avg(l_tax) as info,
  round(avg(l_extendedprice) - 50000, 4) as beta, round(1 + stddev_pop(l_extendedprice), 4) as se, exp(-count(*) / 8.0) as p,
  case min(l_returnflag) when 'A' then 'a' when 'N' then 'C' else 'G' end as a1,
  case max(l_returnflag) when 'A' then 'C' when 'N' then 'g' else 'C' end as a2
  from lineitem group by l_partkey)"""


def _gwas(spark, sf_dir) -> DataFrame:
    flag = lambda c, a: F.when(c == "A", a[0]).when(c == "N", a[1]).otherwise(a[2])
    return _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        (F.avg("l_discount") * 5).alias("frq"), F.round(F.sum("l_quantity"), 6).alias("n"), (1 - F.avg("l_tax")).alias("info"),
        F.round(F.avg("l_extendedprice") - 50000, 4).alias("beta"), F.round(1 + F.stddev_pop("l_extendedprice"), 4).alias("se"), F.exp(-F.count("*") / 8.0).alias("p"),
        flag(F.min("l_returnflag"), "aCG").alias("a1"), flag(F.max("l_returnflag"), "CgC").alias("a2"))


@query(f"""with {_GWAS},
c as (select * from g where info >= 0.95 and least(frq, 1 - frq) > 0.01 and frq between 0 and 1 and p > 0 and p <= 1
  and upper(a1) || upper(a2) in ('AC','AG','CA','CT','GA','GT','TC','TG'))
select cast(part as varchar) as "SNP", upper(a1) as "A1", upper(a2) as "A2", round(beta / se, 6) as "Z", n as "N"
from c where n >= (select quantile_cont(n, 0.9) / 1.5 from c)""")
def sumstats_qc(spark, sf_dir):
    g = _gwas(spark, sf_dir).select(F.col("part").cast("string").alias("RSID"), F.col("a1").alias("EA"), F.col("a2").alias("NEA"), F.col("beta").alias("b"), F.col("se"), F.col("n").alias("WEIGHT"), F.col("frq").alias("freq"), F.col("info").alias("Info"), F.col("p").alias("_p"))
    # Z from effect and error, so that SQL can follow; P is in z_from_p
    out = sumstats.format_sumstats(g.where((F.col("_p") > 0) & (F.col("_p") <= 1)).drop("_p"), sumstats.SumstatsOptions(info_min=0.95))
    return out.withColumn("Z", F.round("Z", 6))


@query(f"""with {_GWAS} select cast(part as varchar) as "SNP", upper(a1) as "A1", upper(a2) as "A2", round(frq, 9) as "FRQ", beta as "BETA",
se as "SE", round(p, 9) as "P", n as "N" from g where least(frq, 1 - frq) > 0.2 and frq between 0 and 1 and p > 0 and p <= 1
and upper(a1) || upper(a2) in ('AC','AG','CA','CT','GA','GT','TC','TG')
and n >= (select quantile_cont(n, 0.9) / 1.5 from g where least(frq, 1 - frq) > 0.2 and frq between 0 and 1 and p > 0 and p <= 1
and upper(a1) || upper(a2) in ('AC','AG','CA','CT','GA','GT','TC','TG'))""")
def sumstats_cojo(spark, sf_dir):
    g = _gwas(spark, sf_dir).select(F.col("part").cast("string").alias("SNP"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), F.col("frq").alias("EAF"), F.col("beta").alias("BETA"), "se", F.col("p").alias("PVAL"), F.col("n").alias("N"))
    out = sumstats.format_sumstats(g, sumstats.SumstatsOptions(format="COJO", maf_min=0.2))
    return out.withColumns({"FRQ": F.round("FRQ", 9), "P": F.round("P", 9)})


@query("""with o as (select o_orderkey as snp, (o_totalprice - (select avg(o_totalprice) from orders)) / (select stddev_pop(o_totalprice) from orders) * 8 as z,
  cast(o_custkey * 10 as double) as n from orders)
select snp, round(z, 6) as z, n from o where z * z < greatest(0.001 * (select max(n) from o), 80)""")
def chisq_filter(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    m = o.agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"))
    rows = o.crossJoin(F.broadcast(m)).select(F.col("o_orderkey").alias("snp"), ((F.col("o_totalprice") - F.col("m")) / F.col("s") * 8).alias("Z"), (F.col("o_custkey") * 10).cast("double").alias("N"))
    return sumstats.chisq_filter(rows).select("snp", F.round("Z", 6).alias("z"), F.col("N").alias("n"))


@query("""select count(*) as n_snps, round(avg(z * z), 6) as mean_chisq, round(median(z * z) / 0.4549, 6) as lambda_gc, round(max(z * z), 6) as max_chisq,
count(*) filter (z * z > 29) as n_significant, round(avg(n), 6) as mean_n, max(n) as max_n
from (select o_totalprice / 100000 - 2 as z, cast(o_custkey as double) as n from orders)""")
def sumstats_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select((F.col("o_totalprice") / 100000 - 2).alias("Z"), F.col("o_custkey").cast("double").alias("N"))
    out = sumstats.summary(rows)
    return out.select("n_snps", *[F.round(c, 6).alias(c) for c in ("mean_chisq", "lambda_gc", "max_chisq")], "n_significant", F.round("mean_n", 6).alias("mean_n"), "max_n")


@query("""select o_orderkey as snp, round(o_totalprice, 2) as idx from orders
where o_orderkey in (select l_orderkey from lineitem where l_quantity > 25) and o_orderkey in (select l_orderkey from lineitem where l_discount > 0.05)
and o_orderkey in (select c_custkey * 3 from customer)""")
def nway_snp_common(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    base = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snp"), F.round("o_totalprice", 2).alias("idx"))
    traits = [li.where("l_quantity > 25").select(F.col("l_orderkey").alias("snp")), li.where("l_discount > 0.05").select(F.col("l_orderkey").alias("snp"))]
    return sumstats.common_snps(base, _t(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("snp")), *traits)


@query("""with m as (select p_size % 3 + 1 || '_' || cast(p_partkey % 500 as varchar) as id, 'rs' || cast(p_partkey % 300 as varchar) as rs, p_partkey as seq from part),
g as (select o_orderkey % 3 + 1 || '_' || cast(o_orderkey % 500 as varchar) as id, o_orderkey from orders),
j as (select g.id, rs, seq, o_orderkey from g join m using (id)),
a as (select * from j qualify row_number() over (partition by rs order by seq, id, o_orderkey) = 1),
b as (select * from a qualify row_number() over (partition by id order by seq, rs) = 1)
select rs as "SNP", o_orderkey from b""")
def rsid_lookup(spark, sf_dir):
    m = _t(spark, sf_dir, "part").select(F.concat(F.lit("chr"), F.col("p_size") % 3 + 1).alias("chr"), (F.col("p_partkey") % 500).alias("pos"), F.concat(F.lit("rs"), F.col("p_partkey") % 300).alias("dbsnp"), F.col("p_partkey").alias("seq"))
    g = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3 + 1).alias("Chr"), (F.col("o_orderkey") % 500).alias("Pos"), "o_orderkey")
    # of rows with one id the least order, as the file's first
    return sumstats.resolve_ids(sumstats.first_of(g, ["Chr", "Pos"], ["o_orderkey"]), m).select("SNP", "o_orderkey")


# --- ranks: a spot is a supplier, a gene a part, a sample a return flag -------------------------------------------

_EXPR = "x as (select l_suppkey as spot, l_partkey as gene, sum(l_quantity) as value from lineitem group by 1, 2)"


def _expr(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(F.lit("s").alias("sample"), F.col("l_suppkey").alias("spot"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


@query(f"""with {_EXPR}, n as (select count(*) as n from part)
select spot, gene, value, rank() over (partition by spot order by value) + (count(*) over (partition by spot, value) - 1) / 2.0
  + n - count(*) over (partition by spot) as rank from x, n""")
def avg_rank(spark, sf_dir):
    n = _t(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    rows = _expr(spark, sf_dir).crossJoin(F.broadcast(n))
    return ranks.average_ranks(rows, F.col("n")).select("spot", "gene", "value", "rank")


@query("""with x as (select l_returnflag as sample, l_suppkey as spot, p_brand as gene, sum(l_quantity) as value from lineitem join part on p_partkey = l_partkey group by all),
sp as (select distinct sample, spot from x), ge as (select distinct sample, gene from x),
f as (select sample, spot, gene, coalesce(value, 0) as value from sp join ge using (sample) left join x using (sample, spot, gene)),
r as (select *, rank() over (partition by sample, spot order by value) + (count(*) over (partition by sample, spot, value) - 1) / 2.0 as r from f),
p as (select sample, gene, exp(avg(ln(r))) as g, count(*) filter (value <> 0) as k, count(*) as n from r group by sample, gene)
select gene, round(exp(sum(n * ln(g)) / sum(n)), 6) as g_mean, round(sum(k) / sum(n), 9) as frac from p group by gene having count(*) = (select count(distinct sample) from p)""")
def slice_mean(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_returnflag").alias("sample"), F.col("l_suppkey").alias("spot"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    partials = ranks.rank_means(x, x.select("sample", "gene").distinct(), x.select("sample", "spot").distinct())
    return ranks.slice_mean(partials).select("gene", F.round("g_mean", 6).alias("g_mean"), F.round("frac", 9).alias("frac"))


@query(f"""with {_EXPR}, n as (select count(*) as n from (select distinct spot from x)), z as (select count(*) as m from part),
r as (select spot, gene, rank() over (partition by spot order by value) + (count(*) over (partition by spot, value) - 1) / 2.0 + m - count(*) over (partition by spot) as r,
  (m - count(*) over (partition by spot) + 1) / 2.0 as zr from x, z),
s as (select sum(ln(zr)) as a from (select distinct spot, zr from r)),
o as (select gene, sum(ln(r) - ln(zr)) as more, count(*) as k from r group by gene)
select p_partkey as gene, round(exp((a + coalesce(more, 0)) / n), 6) as g_mean, coalesce(k, 0) as n_expressed from part left join o on gene = p_partkey, s, n""")
def rank_mean_sparse(spark, sf_dir):
    x = _expr(spark, sf_dir)
    genes = _t(spark, sf_dir, "part").select(F.lit("s").alias("sample"), F.col("p_partkey").alias("gene"))
    return ranks.rank_means(x, genes, x.select("sample", "spot").distinct()).select("gene", F.round("g_mean", 6).alias("g_mean"), "n_expressed")


@query(f"""with {_EXPR} select gene, round(count(*) filter (value <> 0) / (select count(distinct spot) from x) + 1e-12, 9) as frac from x group by gene""")
def expressed_share(spark, sf_dir):
    x = _expr(spark, sf_dir)
    n = x.agg(F.count_distinct("spot")).first()[0]
    return ranks.expressed_share(x, n).select("gene", F.round("frac", 9).alias("frac"))


@query("""with h as (select p_type as species_gene, p_brand as human_gene, p_partkey as seq from part where p_type in (select p_type from part where p_size <= 5)),
a as (select * from h qualify row_number() over (partition by species_gene order by seq, human_gene) = 1),
b as (select * from a qualify row_number() over (partition by human_gene order by seq, species_gene) = 1)
select human_gene as gene, count(*) as n, round(sum(p_retailprice), 2) as value from part join b on p_type = species_gene where p_size <= 5 group by 1""")
def homolog_map(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    pairs = p.select(F.col("p_type").alias("species_gene"), F.col("p_brand").alias("human_gene"), F.col("p_partkey").alias("seq"))
    rows = expression.to_human_genes(p.where("p_size <= 5").select(F.col("p_type").alias("gene"), F.col("p_retailprice").alias("value")), pairs, least=0)
    return rows.groupBy("gene").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(f"with {_EXPR} select spot, gene, round(ln(1 + value * 1e4 / sum(value) over (partition by spot)), 9) as value from x")
def normalize_log1p(spark, sf_dir):
    return expression.normalize_log1p(_expr(spark, sf_dir)).select("spot", "gene", F.round("value", 9).alias("value"))


@query(f"""with {_EXPR}, t as (select sum(value) as t from x),
m as (select spot, gene, value, sum(value) over (partition by gene) * sum(value) over (partition by spot) / t as m from x, t)
select spot, gene, round(greatest(least((value - m) / sqrt(m + m * m / 100), 10), -10), 6) as value from m""")
def pearson_residuals(spark, sf_dir):
    return expression.pearson_residuals(_expr(spark, sf_dir)).select("spot", "gene", F.round("value", 6).alias("value"))


@query(f"""with {_EXPR}, pick as (select gene from x group by gene having gene % 50 = 0), t as (select sum(value) as t from x),
g as (select gene, sum(value) as g from x join pick using (gene) group by gene), s as (select spot, sum(value) as s from x group by spot),
d as (select s.spot, g.gene, coalesce(x.value, 0) as value, g.g * s.s / t.t as m from s cross join g cross join t left join x on x.spot = s.spot and x.gene = g.gene)
select spot, gene, round(greatest(least((value - m) / sqrt(m + m * m / 100), 10), -10), 6) as value from d""")
def residuals_dense(spark, sf_dir):
    """Each fiftieth gene is chosen, as variable ones would be; all spots and their zeros."""
    x = _expr(spark, sf_dir)
    genes = x.where("gene % 50 = 0").select("gene").distinct()
    out = expression.dense_residuals(x, genes, x.select("sample", "spot").distinct())
    return out.select("spot", "gene", F.round("value", 6).alias("value"))


@query("""with s as (select event_id, event_type, user_id from events), k as (select *, count(*) over (partition by user_id) as n from s)
select event_id, user_id from k where n >= 60""")
def annotation_filter(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.lit("s").alias("sample"), "event_id", F.col("user_id").alias("annotation"))
    return expression.keep_annotated(e, 60).select("event_id", F.col("annotation").alias("user_id"))


@query(f"""with {_EXPR}, n as (select count(distinct spot) as n from x), m as (select gene, sum(value) / n as mean, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) as v from x, n group by gene, n),
b as (select gene, ln(v / mean) as d, ln(1 + mean) as lm from m where mean > 0), s as (select min(lm) as lo, max(lm) as hi from b),
c as (select gene, d, least(floor((lm - lo) * 20 / (hi - lo)), 19) as bin from b, s),
w as (select bin, avg(d) as bm, stddev_samp(d) as bs from c group by bin)
select gene, round(case when coalesce(bs, 0) > 0 then (d - bm) / bs else 1 end, 6) as dispersion from c join w using (bin) order by 2 desc, 1 limit 100""")
def variable_genes(spark, sf_dir):
    x = _expr(spark, sf_dir)
    n = x.select("spot").distinct().count()
    out = expression.variable_genes(x, n, 100)
    return out.select("gene", F.round("dispersion", 6).alias("dispersion"))


# --- intervals: genes from parts, variants from orders ------------------------------------------------------------

_GENES = """w as (select cast(p_partkey as varchar) as gene, 'chr' || cast(p_size % 22 + 1 as varchar) as chrom, p_partkey * 50 as tss,
  greatest(0, p_partkey * 50 - 500 - 20 * p_size) as win_start, p_partkey * 50 + 500 + 20 * p_size as win_end, p_partkey as seq from part)"""
_SNPS = "s as (select o_orderkey as snp, 'chr' || cast(o_orderkey % 22 + 1 as varchar) as chrom, (o_orderkey * 37) % 100000 as bp from orders)"


def _genes(spark, sf_dir):
    tss, reach = F.col("p_partkey") * 50, 500 + 20 * F.col("p_size")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("gene"), F.concat(F.lit("chr"), F.col("p_size") % 22 + 1).alias("chrom"), tss.alias("tss"), F.greatest(F.lit(0).cast("long"), tss - reach).alias("win_start"), (tss + reach).alias("win_end"), F.col("p_partkey").alias("seq"))


def _snps(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snp"), F.concat(F.lit("chr"), F.col("o_orderkey") % 22 + 1).alias("chrom"), ((F.col("o_orderkey") * 37) % 100000).alias("bp"))


_NEAR = "n as (select snp, gene from s join w on s.chrom = w.chrom and bp - 1 >= win_start and bp - 1 < win_end qualify row_number() over (partition by snp order by abs(bp - 1 - tss), seq) = 1)"


@query(f"with {_GENES}, {_SNPS} select snp, gene from s join w on s.chrom = w.chrom and bp - 1 >= win_start and bp - 1 < win_end")
def interval_overlap(spark, sf_dir):
    return intervals.interval_join(intervals.snp_points(_snps(spark, sf_dir)), _genes(spark, sf_dir), 2000).select("snp", "gene")


@query(f"with {_GENES}, {_SNPS}, {_NEAR} select s.snp, s.chrom, s.bp, n.gene from s left join n on s.snp = n.snp")
def interval_snp_gene(spark, sf_dir):
    return intervals.snp_to_gene(_snps(spark, sf_dir), _genes(spark, sf_dir), bin_size=2000).select("snp", "chrom", "bp", "gene")


_ENH = """h as (select 'chr' || cast(s_suppkey % 22 + 1 as varchar) as chrom, s_suppkey * 97 % 100000 as start, s_suppkey * 97 % 100000 + 2500 as stop,
  cast(s_suppkey * 7 % 200 as varchar) as gene, s_acctbal as score, s_suppkey * 97 % 100000 + 900 as tss, s_suppkey as seq from supplier)"""


def _enhancers(spark, sf_dir):
    at = F.col("s_suppkey") * 97 % 100000
    return _t(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), F.col("s_suppkey") % 22 + 1).alias("chrom"), at.alias("start"), (at + 2500).alias("end"), (F.col("s_suppkey") * 7 % 200).cast("string").alias("gene"), F.col("s_acctbal").alias("avg_mkscore"), (at + 900).alias("tss"), F.col("s_suppkey").alias("seq"))


@query(f"""with {_ENH}, {_SNPS} select snp, gene from s join h on s.chrom = h.chrom and bp - 1 >= start and bp - 1 < stop
qualify row_number() over (partition by snp order by score desc, seq) = 1""")
def enhancer_pick(spark, sf_dir):
    return intervals.best_enhancer(_snps(spark, sf_dir), _enhancers(spark, sf_dir))


@query(f"""with {_ENH}, {_SNPS}, {_GENES}, {_NEAR}, e as (select snp, gene from s join h on s.chrom = h.chrom and bp - 1 >= start and bp - 1 < stop
qualify row_number() over (partition by snp order by abs(bp - 1 - tss), seq) = 1)
select s.snp, coalesce(e.gene, n.gene) as gene from s left join e on e.snp = s.snp left join n on n.snp = s.snp""")
def enhancer_first(spark, sf_dir):
    return intervals.snp_to_gene(_snps(spark, sf_dir), _genes(spark, sf_dir), _enhancers(spark, sf_dir), "enhancer_first", "nearest_TSS", 2000).select("snp", "gene")


@query("""select gene, chrom, win_start, win_end, tss, ted from (select p_name as gene, 'chr' || cast(p_size % 22 + 1 as varchar) as chrom,
greatest(0, p_partkey * 40 - 1000) as win_start, p_partkey * 40 + 300 + 1000 as win_end,
case when p_type like '%E%' then p_partkey * 40 + 300 else p_partkey * 40 end as tss, case when p_type like '%E%' then p_partkey * 40 else p_partkey * 40 + 300 end as ted, p_partkey
from part where p_size > 5 qualify row_number() over (partition by p_name order by p_partkey) = 1)""")
def gene_windows(spark, sf_dir):
    at = F.col("p_partkey") * 40
    gtf = _t(spark, sf_dir, "part").select((F.col("p_size") % 22 + 1).alias("chromosome"), at.alias("start"), (at + 300).alias("end"), F.when(F.col("p_type").contains("E"), "-").otherwise("+").alias("strand"), F.when(F.col("p_size") > 5, "gene").otherwise("exon").alias("feature"), F.col("p_name").alias("gene_name"), F.col("p_partkey").alias("seq"))
    return intervals.gene_windows(gtf, 1000).drop("seq")


# --- neighbours: a vector is a spot, its first two dimensions the place, its label the annotation -----------------


def _spots(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.lit("s").alias("sample"), F.col("label").alias("annotation"), F.col("vec_id").alias("pos"), F.col("embedding")[0].cast("double").alias("sx"), F.col("embedding")[1].cast("double").alias("sy"), F.col("embedding").alias("vec"))


_KNN = """p as (select vec_id as pos, label as annotation, cast(embedding[1] as double) as sx, cast(embedding[2] as double) as sy, embedding::double[] as v from embeddings),
e as (select a.annotation, a.pos as src, b.pos as dst, sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2) as d from p a join p b on a.annotation = b.annotation
  qualify row_number() over (partition by a.pos order by sqrt((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2), b.pos) <= {k})"""


@query(f"with {_KNN.format(k=11)} select src, dst, round(d, 9) as distance from e")
def knn_spatial(spark, sf_dir):
    return neighbors.knn_spatial(_spots(spark, sf_dir), 11).select("src", "dst", F.round("distance", 9).alias("distance"))


_TOP = "t as (select src, dst, list_cosine_similarity(a.v, b.v) as c from e join p a on a.pos = src join p b on b.pos = dst qualify row_number() over (partition by src order by list_cosine_similarity(a.v, b.v) desc, dst) <= 6)"


def _top(spark, sf_dir):
    s = _spots(spark, sf_dir)
    return neighbors.cosine_topk(neighbors.knn_spatial(s, 21), s, 6)


@query(f"with {_KNN.format(k=21)}, {_TOP} select src, dst, round(c, 6) as similarity from t")
def cosine_topk(spark, sf_dir):
    return _top(spark, sf_dir).select("src", "dst", F.round("similarity", 6).alias("similarity"))


_HOT = "g as (select vec_id as spot, unnest(generate_series(1, 64)) as gene, unnest(embedding)::double as x from embeddings)"


def _gene_values(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select(F.lit("s").alias("sample"), F.col("vec_id").alias("spot"), F.posexplode("embedding").alias("k", "x"))
    return rows.select("sample", "spot", (F.col("k") + 1).cast("string").alias("gene"), F.round(F.greatest(F.col("x").cast("double"), F.lit(0.0)), 2).alias("value")).where("value > 0")


_GSS = f"""{_KNN.format(k=21)}, {_TOP}, {_HOT}, v as (select spot, cast(gene as varchar) as gene, round(greatest(x, 0), 2) as value from g),
r as (select spot, gene, value, rank() over (partition by spot order by value) + (count(*) over (partition by spot, value) - 1) / 2.0 as r from v),
m as (select gene, exp(avg(ln(r))) as gm, count(*) filter (value > 0) / count(*) + 1e-12 as f from r group by gene),
n as (select t.src as spot, r.gene, exp(avg(ln(r.r))) as rg, count(*) filter (r.value > 0) / count(*) as rf from t join r on r.spot = t.dst group by 1, 2),
s as (select spot, n.gene, exp(case when rg / gm > 1 then rg / gm else 0 end * case when rf / f > 1 then 1 else 0 end) - 1 as score from n join m using (gene))"""


def _gss(spark, sf_dir):
    values = _gene_values(spark, sf_dir)
    spots = _spots(spark, sf_dir).select("sample", F.col("pos").alias("spot"))
    genes = spark.range(1, 65).select(F.lit("s").alias("sample"), F.col("id").cast("string").alias("gene"))
    ranked = ranks.average_ranks(values, 64)
    zero = spots.join(ranked.groupBy("sample", "spot").agg(F.first("zero_rank").alias("z")), ["sample", "spot"], "left").select("sample", "spot", F.coalesce("z", F.lit(32.5)).alias("zero_rank"))
    m = ranks.rank_means(values, genes, spots)
    means = m.select("gene", "g_mean", (F.col("n_expressed") / F.col("n_spots") + 1e-12).alias("frac"))
    return gss.specificity(_top(spark, sf_dir).select("sample", "src", "dst"), ranked.select("sample", "spot", "gene", "rank"), zero, means)


@query(f"with {_GSS} select spot, gene, round(score, 5) as score from s where score > 0")
def gene_specificity(spark, sf_dir):
    return _gss(spark, sf_dir).select("spot", "gene", F.round("score", 5).alias("score"))


@query(f"with {_GSS} select gene, round(sum(score) / (select count(*) from embeddings), 5) as avg_mkscore from s where score > 0 group by gene")
def mean_specificity(spark, sf_dir):
    out = gss.mean_score(_gss(spark, sf_dir), _t(spark, sf_dir, "embeddings").count())
    return out.select("gene", F.round("avg_mkscore", 5).alias("avg_mkscore"))


@query(f"""with {_KNN.format(k=6)}, a as (select src, dst, 1.0 as w from e where d > 0 union all select pos, pos, 1.0 from p),
d as (select src, sum(w) as d from a group by src) select a.src, a.dst, round(w / sqrt(x.d * y.d), 9) as w from a join d x on x.src = a.src join d y on y.src = a.dst""")
def graph_norm(spark, sf_dir):
    return neighbors.normalized_graph(neighbors.knn_spatial(_spots(spark, sf_dir), 6)).select("src", "dst", F.round("w", 9).alias("w"))


@query(f"with {_KNN.format(k=2)} select annotation, round(avg(d), 9) as mean_distance from e where src <> dst group by annotation")
def nearest_distance(spark, sf_dir):
    return neighbors.mean_nearest_distance(_spots(spark, sf_dir), ("sample", "annotation")).select("annotation", F.round("mean_distance", 9).alias("mean_distance"))


# --- LD: a vector is a variant, its dimensions individuals; calls by sign and size --------------------------------

_BANDED = """g as (select vec_id as idx, label, list_transform(embedding::double[], lambda x: case when x > 0.1 then 2 when x > -0.05 then 1 else 0 end) as g from embeddings),
l as (select idx, unnest(g) as x, unnest(generate_series(1, 64)) as i from g),
z as (select idx, i, (x - avg(x) over (partition by idx)) / case when stddev_pop(x) over (partition by idx) > 0 then stddev_pop(x) over (partition by idx) else 1 end as z from l),
zz as (select idx, list(z order by i) as z from z group by idx),
ch as (select distinct idx // 100 as a from g), pr as (select x.a, y.a as b from ch x join ch y on y.a <= x.a and (x.a - y.a <= 1)),
ij as (select p.idx as i, q.idx as j, pow(list_dot_product(p.z, q.z) / 64, 2) as r2 from zz p join zz q on abs(p.idx // 100 - q.idx // 100) <= 1),
w as (select i as idx, case when q.label = 9 then null else 'g' || q.label end as gene, sum(r2 - (1 - r2) / 62) as w from ij join g q on q.idx = j group by 1, 2)"""


def _variants(spark, sf_dir):
    # a window of 99 indices: a chunk of 100 pairs with itself and the one before it
    call = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, 2).when(x.cast("double") > -0.05, 1).otherwise(0).cast("tinyint"))
    return _t(spark, sf_dir, "embeddings").select(F.lit(1).alias("chr"), F.col("vec_id").alias("idx"), call.alias("g"), F.when(F.col("label") != 9, F.concat(F.lit("g"), "label")).alias("gene"))


def _weights(spark, sf_dir):
    v = _variants(spark, sf_dir)
    return ld.snp_gene_weight(v, v.select("chr", "idx", "gene"), unit="SNP", window=99)


@query(f"with {_BANDED} select idx, gene, round(w, 6) as w from w")
def snp_gene_weight(spark, sf_dir):
    return _weights(spark, sf_dir).select("idx", "gene", F.round("w", 6).alias("w"))


@query(f"with {_BANDED} select idx, round(coalesce(sum(w) filter (gene is not null), 0), 6) as all_gene, round(sum(w), 6) as base from w group by idx")
def baseline_ld(spark, sf_dir):
    return ld.baseline(_weights(spark, sf_dir)).select("idx", F.round("all_gene", 6).alias("all_gene"), F.round("base", 6).alias("base"))


_SCORES = "sc as (select 'g' || label as gene, 'd' || (vec_id % 7) as spot, sum(abs(embedding[3]::double)) as score from embeddings where label <> 9 group by 1, 2)"


def _scores(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").where("label <> 9")
    return e.groupBy(F.concat(F.lit("g"), "label").alias("gene"), F.concat(F.lit("d"), (F.col("vec_id") % 7)).alias("spot")).agg(F.sum(F.abs(F.col("embedding")[2].cast("double"))).alias("score"))


@query(f"with {_BANDED}, {_SCORES} select idx, spot, round(sum(w * score), 5) as l2 from w join sc using (gene) group by idx, spot")
def annot_ld(spark, sf_dir):
    spots = spark.range(7).select(F.concat(F.lit("d"), "id").alias("spot"), F.lit(1).alias("chunk"), F.col("id").alias("seq"))
    rows = ld.annotation_chunks(_weights(spark, sf_dir), _scores(spark, sf_dir), spots).select("idx", F.posexplode("l2").alias("k", "l2"))
    return rows.where("l2 <> 0").select("idx", F.concat(F.lit("d"), "k").alias("spot"), F.round("l2", 5).alias("l2"))


@query(f"""with {_SCORES}, c as (select 'g' || label as gene, count(*) as k from embeddings where label <> 9 group by 1)
select spot, round(sum(k * score), 5) as m from c join sc using (gene) group by spot""")
def m_values(spark, sf_dir):
    return ld.m_values(_variants(spark, sf_dir), _scores(spark, sf_dir)).select("spot", F.round("m", 5).alias("m"))


@query("""with g as (select vec_id as idx, list_transform(embedding::double[], lambda x: case when x > 0.1 then 2 when x > -0.05 then 1 else 0 end) as g from embeddings)
select idx, round(list_sum(g) / 128.0, 9) as freq, round(least(list_sum(g) / 128.0, 1 - list_sum(g) / 128.0), 9) as maf, len(list_filter(g, lambda x: x = 1)) as het_miss
from g where least(list_sum(g) / 128.0, 1 - list_sum(g) / 128.0) > 0.3""")
def allele_stats(spark, sf_dir):
    s = ld.common(ld.valid_snps(ld.allele_stats(_variants(spark, sf_dir))), 0.3)
    return s.select("idx", F.round("freq", 9).alias("freq"), F.round("maf", 9).alias("maf"), F.col("het_miss").cast("long").alias("het_miss"))


def _placed(spark, sf_dir, chromosome):
    # in ten-thousandths of a centimorgan, which doubles hold exactly
    place = F.col("o_orderkey") * 100 + F.col("o_orderkey") % 7 * 5
    return _t(spark, sf_dir, "orders").select(chromosome.alias("chr"), F.col("o_orderkey").alias("idx"), place.cast("double").alias("coord"))


@query("""with s as (select o_orderkey as idx, o_orderkey % 22 + 1 as chr, o_orderkey * 100 + o_orderkey % 7 * 5 as k from orders)
select chr, idx, count(*) over (partition by chr order by k range between unbounded preceding and 10001 preceding) as left_edge from s""")
def ld_window_left(spark, sf_dir):
    """The left edge of every variant's window, by the expression of ``ld.band``."""
    return ld.left_edges(_placed(spark, sf_dir, F.col("o_orderkey") % 22 + 1), 10000).select("chr", "idx", F.col("left").alias("left_edge"))


# --- regression ---------------------------------------------------------------------------------------------------


@query("""with o as (select o_orderkey as i, o_totalprice / 1000 as y, 1.0 + o_custkey % 97 as x from orders),
b as (select floor(((row_number() over (order by i)) * 20 - 1) / (select count(*) from o)) as block, x, y from o),
s as (select block, sum(x * y) as xy, sum(x * x) as xx from b group by block),
t as (select *, sum(xy) over () as sxy, sum(xx) over () as sxx, count(*) over () as n from s),
v as (select n * sxy / sxx - (n - 1) * (sxy - xy) / (sxx - xx) as v, n from t)
select round(avg(v), 6) as est, round(sqrt(var_samp(v) / max(n)), 6) as se from v""")
def jackknife_ratio(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1000).alias("y"), (1.0 + F.col("o_custkey") % 97).alias("x"))
    out = regress.ratio_jackknife(regress.with_blocks(o, ["i"], 20).withColumn("one", F.lit(1)), "x", "y", ["one"])
    return out.select(F.round("est", 6).alias("est"), F.round("se", 6).alias("se"))


@query()
def ldsc_spots(spark, sf_dir):
    """Variants are vectors, spots their first eight dimensions' sizes, chi-squares from the ninth."""
    e = _t(spark, sf_dir, "embeddings")
    z = 1 + 8 * F.abs(F.col("embedding")[8].cast("double"))
    trait = e.select(F.col("vec_id").alias("snp"), z.alias("z"), (1000 + F.col("vec_id") % 50).cast("double").alias("n"))
    base = e.select(F.col("vec_id").alias("snp"), F.col("vec_id").alias("idx"), F.array(F.lit(1.0) + F.abs(F.col("embedding")[9].cast("double")), F.lit(2.0) + F.col("label") % 3).alias("vals")).withColumnRenamed("vals", "base")
    weight = e.select(F.col("vec_id").alias("snp"), (1 + F.abs(F.col("embedding")[10].cast("double"))).alias("l2"))
    rows = regress.regression_rows(trait, base, weight, 20)
    return regress.spatial_ldsc(rows, *_sizes(e))


def _sizes(e):
    scores = e.select(F.col("vec_id").alias("snp"), F.lit(1).alias("chunk"), F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x).cast("float")).alias("l2"))
    return scores, e.sparkSession.range(1).select(F.lit(1).alias("chunk"), F.array(*[F.lit(f"d{k}") for k in range(8)]).alias("spots"))


@query("""with e as (select vec_id as snp, 1000.0 + vec_id % 50 as n, (1 + 8 * abs(embedding[9]::double)) ** 2 as y, greatest(1 + abs(embedding[11]::double), 1) as wl, embedding from embeddings),
g as (select *, floor((row_number() over (order by snp) * 20 - 1) / count(*) over ()) as block, avg(n) over () as nbar from e),
r as (select 'd' || (k - 1) as spot, block, nbar, n, y, wl, abs(embedding[k])::double as x from g, range(1, 9) t(k)),
h as (select spot, least(greatest(10000 * (avg(y) - 1) / avg(x * n), 0), 1) as h from r group by spot),
w as (select *, 1 / (2 * (1 + h * n / 10000 * greatest(x, 1)) ** 2) / wl as w from r join h using (spot)),
s as (select spot, block, max(nbar) as nbar, sum(w * x * x) as a, sum(w * x) as b, sum(w) as c, sum(w * x * y) as d, sum(w * y) as f from w group by spot, block),
t as (select *, sum(a) over v as ta, sum(b) over v as tb, sum(c) over v as tc, sum(d) over v as td, sum(f) over v as tf, count(*) over v as m from s window v as (partition by spot)),
q as (select spot, nbar, m, m * (tc * td - tb * tf) / (ta * tc - tb * tb)
  - (m - 1) * ((tc - c) * (td - d) - (tb - b) * (tf - f)) / ((ta - a) * (tc - c) - (tb - b) ** 2) as v from t),
o as (select spot, avg(v) / max(nbar) as beta, sqrt(var_samp(v) / max(m)) / max(nbar) as se from q group by spot)
select spot, round(beta, 9) as beta, round(se, 9) as se, round(beta / se, 5) as z from o""")
def ldsc_simple(spark, sf_dir):
    """As ``ldsc_spots`` without baseline columns: a spot's LD and an intercept, which have a closed form."""
    e = _t(spark, sf_dir, "embeddings")
    trait = e.select(F.col("vec_id").alias("snp"), (1 + 8 * F.abs(F.col("embedding")[8].cast("double"))).alias("z"), (1000 + F.col("vec_id") % 50).cast("double").alias("n"))
    base = e.select(F.col("vec_id").alias("snp"), F.col("vec_id").alias("idx"), F.array().cast("array<double>").alias("base"))
    weight = e.select(F.col("vec_id").alias("snp"), (1 + F.abs(F.col("embedding")[10].cast("double"))).alias("l2"))
    out = regress.spatial_ldsc(regress.regression_rows(trait, base, weight, 20), *_sizes(e))
    return out.select("spot", F.round("beta", 9).alias("beta"), F.round("se", 9).alias("se"), F.round("z", 5).alias("z"))


# --- diagnosis ----------------------------------------------------------------------------------------------------


def _diag(spark, sf_dir):
    scores = _gene_values(spark, sf_dir).select("gene", "spot", F.col("value").alias("score"))
    e = _t(spark, sf_dir, "embeddings")
    return scores, e.select(F.col("vec_id").alias("spot"), F.exp(-10 * F.abs(F.col("embedding")[4].cast("double"))).alias("p")), e.select(F.col("vec_id").alias("spot"), F.col("label").alias("annotation"))


_VALUES = f"{_HOT}, v as (select spot, cast(gene as varchar) as gene, round(greatest(x, 0), 2) as score from g), y as (select vec_id as spot, label as annotation, -log10(exp(-10 * abs(embedding[5]::double))) as y from embeddings)"


@query(f"with {_VALUES} select gene, round(corr(score, y), 6) as pcc from v join y using (spot) group by gene")
def gene_pcc(spark, sf_dir):
    s, r, _ = _diag(spark, sf_dir)
    return diagnose.gene_correlation(s, r).select("gene", F.round("pcc", 6).alias("pcc"))


@query(f"""with {_VALUES}, m as (select gene, annotation, median(score) as m from v join y using (spot) group by gene, annotation)
select gene, annotation, round(m, 9) as median_gss from m qualify row_number() over (partition by gene order by m desc, annotation) = 1""")
def gene_argmax(spark, sf_dir):
    s, _, a = _diag(spark, sf_dir)
    return diagnose.best_annotation(diagnose.median_by_annotation(s, a)).select("gene", "annotation", F.round("median_gss", 9).alias("median_gss"))


@query(f"""with {_VALUES}, m as (select gene, annotation, median(score) as m from v join y using (spot) group by gene, annotation),
b as (select * from m qualify row_number() over (partition by gene order by m desc, annotation) = 1), c as (select gene, corr(score, y) as pcc from v join y using (spot) group by gene)
select gene, annotation, round(m, 9) as median_gss, round(pcc, 6) as pcc from b join c using (gene) order by c.pcc desc, gene limit 50""")
def gene_table(spark, sf_dir):
    out = diagnose.gene_table(*_diag(spark, sf_dir)).limit(50)
    return out.select("gene", "annotation", F.round("median_gss", 9).alias("median_gss"), F.round("pcc", 6).alias("pcc"))


@query("select l_orderkey, l_linenumber, l_partkey, least(l_extendedprice, q) as price from lineitem, (select quantile_cont(l_extendedprice, 0.99) as q from lineitem)")
def winsorize(spark, sf_dir):
    rows = diagnose.winsorize(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 0.99)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))


@query("""with s as (select o_orderkey as snp, o_orderkey % 22 + 1 as chr, (o_orderkey * 37) % 100000 as bp from orders), m as (select chr, max(bp) as l from s group by chr),
c as (select chr, coalesce(sum(l) over (order by chr rows between unbounded preceding and 1 preceding), 0) as off from m) select snp, s.chr, bp, cast(bp + off as bigint) as x from s join c on c.chr = s.chr""")
def manhattan_pos(spark, sf_dir):
    s = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snp"), (F.col("o_orderkey") % 22 + 1).alias("chr"), ((F.col("o_orderkey") * 37) % 100000).alias("bp"))
    return diagnose.cumulative_position(s).select("snp", "chr", "bp", "x")


def _pick_sql(small, most):
    return f"""with s as (select o_orderkey as snp, exp(-o_totalprice / 40000) as p from orders), k as (select count(*) filter (p < {small}) > {most} as many from s)
select snp, round(p, 9) as p from s, k where many and p < {small} union all select snp, round(p, 9) from (select * from s order by p, snp limit {most}), k where not many"""


def _pick(spark, sf_dir, small, most):
    s = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snp"), F.exp(-F.col("o_totalprice") / 40000).alias("p"))
    return diagnose.pick_snps(s, small=small, most=most).select("snp", F.round("p", 9).alias("p"))


@query(_pick_sql(1e-5, 500))
def snp_pick_small(spark, sf_dir):
    return _pick(spark, sf_dir, 1e-5, 500)


@query(_pick_sql(1e-9, 1000))
def snp_pick_top(spark, sf_dir):
    return _pick(spark, sf_dir, 1e-9, 1000)


@query("select distinct l_partkey as gene from lineitem where l_quantity > 45 except select p_partkey from part where p_size > 10")
def unmatched_genes(spark, sf_dir):
    return diagnose.unmatched_genes(_t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("gene")), _t(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("gene")))


@query("""select o_orderkey as snp, coalesce(n, 0) as value from orders left join (select l_orderkey, cast(count(*) as double) as n from lineitem where l_tax > 0.04 group by 1) on l_orderkey = o_orderkey""")
def annotation_reindex(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").where("l_tax > 0.04").groupBy(F.col("l_orderkey").alias("snp")).agg(F.count("*").cast("double").alias("value")).withColumn("name", F.lit("tax"))
    return intervals.add_annotation(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snp")), x).select("snp", "value")


@query(_OUT.format(e="select n_name as annotation, exp(-s_acctbal / 3000) as p from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 0"))
def cauchy_joined(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("spot"), F.exp(-F.col("s_acctbal") / 3000).alias("p"), "s_nationkey")
    spots = s.join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("spot", F.col("n_name").alias("annotation"))
    out = combine.cauchy_combination(s.select("spot", "p"), spots)
    return out.select("annotation", F.round(-F.log10("p_cauchy"), 6).alias("logp_cauchy"), F.round("p_median", 9).alias("p_median"))


# --- not in SQL ---------------------------------------------------------------------------------------------------


@query()
def z_from_p(spark, sf_dir):
    p = F.exp(-F.col("value") / 10)
    return _t(spark, sf_dir, "events").select("event_id", p.alias("p"), signed_z(p, F.when(F.col("user_id") % 2 == 0, -1.0).otherwise(1.0)).alias("z"))


#: The upper tail of a normal variable x > 0 by the series of its density times x ** (2 k + 1) over odd factorials.
_TAIL = """case when x > 9 then 0 when x < 1e-9 then 0.5 else 0.5 - exp(-x * x / 2) / sqrt(2 * pi()) *
  list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(x) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) end"""


@query(f"""with e as (select event_id, value / 20 as z, abs(value / 20) as x from events)
select event_id, round(z, 9) as z, round(greatest(2 * ({_TAIL}), 0), 9) as p from e""")
def p_from_z(spark, sf_dir):
    out = diagnose.with_p(_t(spark, sf_dir, "events").select("event_id", (F.col("value") / 20).alias("z")))
    return out.select("event_id", F.round("z", 9).alias("z"), F.round("p", 9).alias("p"))


@query(f"""with e as (select event_id, value, abs(value / 100) as x from events)
select event_id, round(case when value < 0 then 1 - ({_TAIL}) else {_TAIL} end, 9) as p from e""")
def normal_tail(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.round(norm_sf(F.col("value") / 100), 9).alias("p"))


@query()
def pca_latent(spark, sf_dir):
    return expression.pca(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 8, "embedding").select("vec_id", F.transform("latent", lambda x: F.round(F.abs(x), 6)).alias("latent"))


@query()
def variable_genes_counts(spark, sf_dir):
    """Spots are orders' customers, genes parts, counts quantities; a local fit is not for SQL."""
    x = _expr(spark, sf_dir)
    return expression.variable_genes_counts(x, x.select("spot").distinct().count(), 100).select("gene", F.round("dispersion", 6).alias("dispersion"))


@query()
def latent_graph(spark, sf_dir):
    """A small auto-encoder over all vectors as spots, their labels learned too."""
    s = _spots(spark, sf_dir).withColumn("label", F.coalesce(F.col("annotation").cast("int"), F.lit(0)))
    near = neighbors.knn_spatial(s, 11, ("sample",)).where("distance > 0")
    shape = graph_latent.Shape(hidden1=64, hidden2=32, gat1=16, gat2=8, epochs=20)
    out = graph_latent.graph_latent(s.select("pos", "sx", "sy", F.col("vec").cast("array<double>").alias("vec"), "label"), near, shape, labels=10)
    return out.select("pos", F.transform("latent", lambda x: F.round(x, 3)).alias("latent"))


@query(f"""with {_VALUES}, m as (select spot, gene, score, avg(score) over (partition by gene) as m, stddev_samp(score) over (partition by gene) as s, max(score) over (partition by gene) as top from v)
select spot, gene, round(least((score - m) / case when s > 0 then s else 1 end, 10), 6) as value from m where top > 0""")
def scaled_expression(spark, sf_dir):
    x = _gene_values(spark, sf_dir)
    spots = _t(spark, sf_dir, "embeddings").select(F.lit("s").alias("sample"), F.col("vec_id").alias("spot"))
    return expression.scale(x, expression.gene_moments(x, spots.count()), spots).select("spot", "gene", F.round("value", 6).alias("value"))
