"""The steps of an analysis: each reads tables, gives a DataFrame or writes tables, and can be run by itself.

A sample is three tables in a folder: ``expression`` (sample, spot, gene, value), ``spots`` (sample, spot, pos, sx, sy,
annotation) and, where a latent is at hand, ``latent`` (sample, spot, rep, vec).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import combine, diagnose, expression, graph_latent, gss, intervals, ld, neighbors, ranks, regress, sumstats
from ..sources import plink, sinks, text
from . import config as C
from ..tables import cut
from .report import manhattan, render, scatter


def format_sumstats(spark: SparkSession, c: C.FormatSumstatsConfig) -> DataFrame:
    n = int(c.n) if c.n is not None and str(c.n).isdigit() else None
    names = dict(c.names) | ({"N": c.n} if c.n is not None and n is None else {})
    options = sumstats.SumstatsOptions(c.format, c.info_min, c.maf_min, n, c.keep_chr_pos, names)
    out = sumstats.format_sumstats(text.read_gwas(spark, c.sumstats), options, text.read_dbsnp(spark, c.dbsnp) if c.dbsnp else None)
    sinks.write_sumstats(out, f"{c.out}.{'sumstats' if c.format == 'sumstats' else 'cojo'}")
    return out


def create_slice_mean(spark: SparkSession, c: C.SliceMeanConfig) -> DataFrame:
    rows = None
    for sample, path in sorted(c.expression_paths.items()):
        x = spark.read.parquet(f"{path}/expression").withColumn("sample", F.lit(sample))
        rows = x if rows is None else rows.unionByName(x)
    if c.homolog_file:
        rows = expression.to_human_genes(rows, text.read_homologs(spark, c.homolog_file))
    rows = rows.select("sample", "spot", "gene", "value")
    genes = rows.select("sample", "gene").distinct()
    shared = genes.groupBy("gene").count().where(F.col("count") == len(c.expression_paths)).select("gene")
    rows, genes = rows.join(shared, "gene", "left_semi"), genes.join(shared, "gene", "left_semi")
    out = ranks.slice_mean(ranks.rank_means(rows, genes, rows.select("sample", "spot").distinct()))
    sinks.write_table(out, c.slice_mean_output_file)
    return out


def find_latent(spark: SparkSession, c: C.LatentConfig) -> None:
    """Principal components of the scaled variable genes, as ``latent_PCA``, and with ``c.graph`` what a graph-attention
    auto-encoder makes of them (or, without ``c.input_pca``, of the genes themselves), as ``latent_GVAE``.  Another
    representation is an input: add its rows to the table under another ``rep``."""
    rows = expression.keep_expressed(spark.read.parquet(f"{c.input_path}/expression").withColumn("sample", F.lit(c.sample_name)))
    spots = spark.read.parquet(f"{c.input_path}/spots").withColumn("sample", F.lit(c.sample_name))
    if c.annotation:
        spots = expression.keep_annotated(spots.withColumn("annotation", F.col(c.annotation)))
        rows = rows.join(spots.select("sample", "spot"), ["sample", "spot"], "left_semi")
    n = spots.count()
    of_counts = c.data_layer in ("count", "counts", "X")  # genes by their raw counts
    values = expression.normalize_log1p(rows) if of_counts else rows
    top = cut(expression.variable_genes_counts(rows, n, c.feat_cell) if of_counts else expression.variable_genes(rows, n, c.feat_cell))
    if of_counts and c.pearson_residuals:  # not scaled
        scaled = expression.dense_residuals(rows, top, spots)
    else:
        values = values.join(F.broadcast(top.select("gene")), "gene", "left_semi")  # feat_cell genes at most
        scaled = expression.scale(values, expression.gene_moments(values, n), spots)
    vectors = scaled.groupBy("sample", "spot").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene", "value"))), lambda x: x["value"]).alias("vec"))
    width = top.count()
    out = expression.pca(vectors, min(c.n_comps, width, max(1, n - 1))).select("sample", "spot", F.lit("latent_PCA").alias("rep"), F.col("latent").alias("vec"))
    if c.graph:
        out = cut(out)
        inputs = out.select("spot", "vec") if c.input_pca else vectors.select("spot", "vec")
        out = out.unionByName(graph_rows(c, spots, inputs))
    sinks.write_table(out, c.layout.latent(c.sample_name))
    sinks.write_table(spots, c.layout.spots(c.sample_name))
    sinks.write_table(rows, c.layout.expression(c.sample_name))


def graph_rows(c: C.LatentConfig, spots: DataFrame, vectors: DataFrame) -> DataFrame:
    """The latent table's rows of ``latent_GVAE``; annotations, where they are asked for, are learned as labels."""
    sample = F.lit(c.sample_name)
    near = neighbors.knn_spatial(spots.select("sample", "pos", "sx", "sy"), c.n_neighbors, ("sample",)).where("distance > 0")
    nodes = spots.join(vectors, "spot")
    labels = 0
    if c.annotation:
        names = spots.groupBy("annotation").count()
        labels = names.count()
        names = names.select("annotation", (F.row_number().over(W.orderBy("annotation")) - 1).alias("label"))  # a row an annotation
        nodes = nodes.join(names, "annotation")
    else:
        nodes = nodes.withColumn("label", F.lit(-1))
    shape = graph_latent.Shape(c.feat_hidden1, c.feat_hidden2, c.gat_hidden1, c.gat_hidden2, c.nheads, c.p_drop, c.gat_lr, c.gcn_decay, c.epochs, threshold=c.convergence_threshold, label_weight=c.label_w, rec_weight=c.rec_w, seed=c.seed)
    found = graph_latent.graph_latent(nodes.select("pos", "sx", "sy", "vec", "label"), near, shape, labels)
    return found.join(spots.select("pos", "spot"), "pos").select(sample.alias("sample"), "spot", F.lit("latent_GVAE").alias("rep"), F.col("latent").alias("vec"))


def latent_to_gene(spark: SparkSession, c: C.LatentToGeneConfig) -> DataFrame:
    rows = spark.read.parquet(c.layout.expression(c.sample_name)).select("sample", "spot", "gene", "value")
    spots = spark.read.parquet(c.layout.spots(c.sample_name))
    keys = ("sample", "annotation") if c.annotation else ("sample",)
    if c.annotation:
        spots = spots.withColumn("annotation", F.col(c.annotation)).where("annotation is not null")
        rows = rows.join(spots.select("sample", "spot"), ["sample", "spot"], "left_semi")
    if c.homolog_file:
        rows = expression.to_human_genes(rows, text.read_homologs(spark, c.homolog_file))
    latent = spark.read.parquet(c.layout.latent(c.sample_name)).where(F.col("rep") == c.latent_representation).join(spots.select("sample", "spot", "pos"), ["sample", "spot"])
    near = neighbors.knn_spatial(spots, c.num_neighbour_spatial, keys)
    close = neighbors.cosine_topk(near.select("sample", "src", "dst"), latent.select("sample", "pos", "vec"), c.num_neighbour)
    name = spots.select("sample", "pos", "spot")
    edges = close.join(name.withColumnRenamed("pos", "src").withColumnRenamed("spot", "a"), ["sample", "src"]).join(name.withColumnRenamed("pos", "dst").withColumnRenamed("spot", "b"), ["sample", "dst"]).select("sample", F.col("a").alias("src"), F.col("b").alias("dst"))
    if c.gM_slices:
        means = spark.read.parquet(c.gM_slices)
        rows = rows.join(means.select("gene"), "gene", "left_semi")
    genes = rows.select("sample", "gene").distinct()
    per = genes.groupBy("sample").agg(F.count("*").alias("n_genes"))
    ranked = ranks.average_ranks(rows.join(per, "sample"), F.col("n_genes"))
    everyone = spots.select("sample", "spot")
    zero = everyone.join(per, "sample").join(ranked.groupBy("sample", "spot").agg(F.first("zero_rank").alias("z")), ["sample", "spot"], "left").select("sample", "spot", F.coalesce("z", (F.col("n_genes") + 1) / 2).alias("zero_rank"))
    if not c.gM_slices:
        means = ranks.rank_means(rows, genes, everyone).select("gene", "g_mean", (F.col("n_expressed") / F.col("n_spots") + 1e-12).alias("frac"))
    if c.no_expression_fraction:
        means = means.withColumn("frac", F.lit(0.0) + 1e-12)
    out = gss.specificity(edges, ranked.select("sample", "spot", "gene", "rank"), zero, means)
    sinks.write_table(out, c.layout.gss(c.sample_name))
    sinks.write_table(genes, c.layout.gss(c.sample_name) + "_genes")
    return out


def generate_ldscore(spark: SparkSession, c: C.LDScoreConfig) -> None:
    scores = spark.read.parquet(c.layout.gss(c.sample_name))
    spots = spark.read.parquet(c.layout.spots(c.sample_name)).select("spot").distinct()
    windows = intervals.gene_windows(text.read_gtf(spark, c.gtf_annotation_file), c.gene_window_size).join(spark.read.parquet(c.layout.gss(c.sample_name) + "_genes").select("gene").distinct(), "gene", "left_semi")
    enhancers = None
    if c.enhancer_annotation_file:
        means = gss.mean_score(scores, spots.count())
        enhancers = intervals.enhancer_table(text.read_bed(spark, c.enhancer_annotation_file), means, windows)
    panels, calls = None, None
    for chrom in c.chromosomes():
        bim = text.read_bim(spark, f"{c.bfile_root}.{chrom}.bim").withColumn("chr", F.lit(chrom))
        n = text.read_fam(spark, f"{c.bfile_root}.{chrom}.fam").count()
        bed = plink.read_bed_files(spark, f"{c.bfile_root}.{chrom}.bed", n, chrom)
        panels = bim if panels is None else panels.unionByName(bim)
        calls = bed if calls is None else calls.unionByName(bed)
    snps = ld.valid_snps(ld.allele_stats(calls.join(panels, ["chr", "idx"])))
    snps = snps.withColumn("chrom", F.concat(F.lit("chr"), "chr"))
    named = intervals.snp_to_gene(snps.select("chr", "idx", "snp", "chrom", "bp", "cm"), windows, enhancers, c.gene_window_enhancer_priority or "gene_window_first", c.snp_multiple_enhancer_strategy)
    sinks.write_table(named, c.layout.snp_gene(c.sample_name), "chr")
    named = spark.read.parquet(c.layout.snp_gene(c.sample_name))
    keep = None
    if c.keep_snp_root:
        keep = snps.select("chr", "idx", "snp").join(text.by_chromosome(spark, c.keep_snp_root + ".{chr}.snp", text.read_names, c.chromosomes()), ["chr", "snp"], "left_semi").select("chr", "idx")
    options = {"unit": c.ld_unit, "window": c.ld_wind}
    panel = snps.select("chr", "idx", "bp", "cm", "g")
    name = snps.select("chr", "idx", "snp")
    sinks.write_table(ld.snp_gene_weight(panel, named.select("chr", "idx", "gene"), keep, **options), c.layout.baseline(c.sample_name) + "_weights", "chr")
    weights = spark.read.parquet(c.layout.baseline(c.sample_name) + "_weights")
    base = ld.baseline(weights)
    sinks.write_table(base.join(name, ["chr", "idx"]), c.layout.baseline(c.sample_name), "chr")
    sinks.write_table(ld.regression_weights(panel, keep, base, **options).join(name, ["chr", "idx"]), c.layout.weights(c.sample_name), "chr")
    kept = spark.read.parquet(c.layout.weights(c.sample_name)).select("chr", "idx", "l2")
    sinks.write_weights(kept.join(snps.select("chr", "idx", "snp", "bp", "cm"), ["chr", "idx"]), c.layout.weights(c.sample_name) + "_text")
    if c.additional_baseline_annotation:
        extra = text.by_chromosome(spark, c.additional_baseline_annotation + "/baseline.{chr}.annot.gz", text.read_annotation, c.chromosomes())
        targets = name.join(extra, ["chr", "snp"]).select("chr", "idx", F.col("name").alias("target"), "value")
        more = ld.ld_scores(panel, targets, **options)
        if keep is not None:
            more = more.join(keep, ["chr", "idx"], "left_semi")
        sinks.write_table(more.join(name, ["chr", "idx"]), c.layout.baseline(c.sample_name) + "_extra", "chr")
    order = in_chunks(spots, c.spots_per_chunk)
    sinks.write_scores(ld.annotation_chunks(weights, scores, order).join(name, ["chr", "idx"]), c.layout.ldscore(c.sample_name))
    sinks.write_table(order, c.layout.ldscore(c.sample_name) + "_spots")
    common = ld.common(snps).select("chr", "idx")
    genes = named.select("chr", "idx", "gene")
    m = ld.m_values(genes, scores).join(ld.m_values(genes, scores, common).withColumnRenamed("m", "m_5_50"), ["chr", "spot"], "left")
    sinks.write_table(m.na.fill(0.0, ["m_5_50"]), c.layout.ldscore(c.sample_name) + "_m", "chr")


def in_chunks(spots: DataFrame, per_chunk: int) -> DataFrame:
    """``spots`` (spot) with ``seq``, their number by name, and ``chunk``, from 1."""
    return regress.numbered(spots, ["spot"]).drop("total").withColumn("chunk", (F.floor(F.col("seq") / per_chunk) + 1).cast("int"))


def spatial_ldsc(spark: SparkSession, c: C.SpatialLDSCConfig) -> DataFrame:
    """All traits in one pass over the LD scores.  ``shared_snps``: variants that all traits have; else each trait has its own."""
    base = spark.read.parquet(c.layout.baseline(c.sample_name))
    weights = text.read_weights(spark, c.w_file).select("snp", "l2") if c.w_file else spark.read.parquet(c.layout.weights(c.sample_name)).select("snp", "l2")
    base = base.select("snp", (F.col("chr").cast("long") * 1_000_000_000 + F.col("idx")).alias("idx"), F.array("all_gene", "base").alias("base"))
    extra = c.layout.baseline(c.sample_name) + "_extra"
    if c.use_additional_baseline_annotation and sinks.done(spark, extra):
        more = spark.read.parquet(extra).groupBy("snp").agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "w"))), lambda x: x["w"]).alias("more"))
        base = base.join(more, "snp").select("snp", "idx", F.concat("base", "more").alias("base"))
    scores = spark.read.parquet(c.layout.ldscore(c.sample_name))
    if c.chunk_range:
        scores = scores.where(F.col("chunk").between(*c.chunk_range))
    order = spark.read.parquet(c.layout.ldscore(c.sample_name) + "_spots").groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "spot"))), lambda x: x["spot"].cast("string")).alias("spots"))
    files = {t: sumstats.chisq_filter(text.read_sumstats(spark, p).withColumnRenamed("z", "Z").withColumnRenamed("n", "N"), c.chisq_max).withColumnRenamed("Z", "z").withColumnRenamed("N", "n") for t, p in c.sumstats.items()}
    if c.shared_snps:
        for f in files.values():
            base = base.join(f.select("snp"), "snp", "left_semi")
    rows = None
    for trait, f in files.items():
        r = regress.regression_rows(f, base, weights, c.n_blocks).withColumn("trait", F.lit(trait))
        rows = r if rows is None else rows.unionByName(r)
    out = cut(regress.spatial_ldsc(rows, scores, order))  # a row a trait and spot
    for trait in files:
        of = out.where(F.col("trait") == trait)
        sinks.write_table(of, c.layout.ldsc(c.sample_name, trait))
        sinks.write_results(of, c.layout.ldsc(c.sample_name, trait) + "_text")
    return out


def cauchy(spark: SparkSession, c: C.CauchyConfig) -> DataFrame:
    results, places = None, None
    for sample in c.samples:
        layout = C.Layout(c.workdir)
        r = spark.read.parquet(layout.ldsc(sample, c.trait_name)).withColumn("sample", F.lit(sample))
        s = spark.read.parquet(layout.spots(sample)).select(F.lit(sample).alias("sample"), F.col("spot").cast("string").alias("spot"), F.col(c.annotation).alias("annotation"))
        results, places = (r, s) if results is None else (results.unionByName(r), places.unionByName(s))
    out = combine.cauchy_combination(results, places)
    sinks.write_small(out, c.output_file or C.Layout(c.workdir).cauchy(c.samples[0], c.trait_name))
    return out


def report(spark: SparkSession, c: C.ReportConfig) -> str:
    """Tables that explain a trait's result, and a page of them.  The regional result is made if it is missing."""
    layout = c.layout
    results = spark.read.parquet(layout.ldsc(c.sample_name, c.trait_name)).select("spot", "p")
    spots = spark.read.parquet(layout.spots(c.sample_name)).select(F.col("spot").cast("string").alias("spot"), F.col(c.annotation).alias("annotation"))
    scores = spark.read.parquet(layout.gss(c.sample_name)).select("gene", F.col("spot").cast("string").alias("spot"), "score")
    genes = diagnose.gene_table(scores, results, spots)
    where = layout.report(c.sample_name, c.trait_name)
    sinks.write_small(genes, f"{where}/genes", None)
    stats = diagnose.pick_snps(diagnose.with_p(text.read_sumstats(spark, c.sumstats_file)))
    table = diagnose.manhattan_table(stats.drop("p"), spark.read.parquet(layout.snp_gene(c.sample_name)).where("gene is not null"), genes)
    sinks.write_table(table, f"{where}/manhattan")
    if not sinks.done(spark, layout.cauchy(c.sample_name, c.trait_name)):
        cauchy(spark, C.CauchyConfig(c.workdir, c.trait_name, c.annotation, c.sample_name))
    regions = spark.read.csv(layout.cauchy(c.sample_name, c.trait_name), header=True, inferSchema=True)
    top = genes.limit(c.top_corr_genes).toPandas()
    # what is drawn is bounded: 100,000 variants at most come from pick_snps' rule, so many spots are shown
    places = spark.read.parquet(layout.spots(c.sample_name)).select(F.col("spot").cast("string").alias("spot"), "sx", "sy").join(results.withColumn("logp", -F.log10("p")), "spot").orderBy(F.xxhash64("spot")).limit(100_000).toPandas()
    drawn = spark.read.parquet(f"{where}/manhattan").select("snp", "chr", "x", "p", "hover").orderBy("p", "snp").limit(100_000).toPandas()
    return render(f"{c.sample_name}: {c.trait_name}", {"Regions": regions.limit(1000).toPandas(), "Genes": top}, {"sample": c.sample_name, "trait": c.trait_name, "annotation": c.annotation}, {"Spots": scatter(places, "logp"), "Variants": manhattan(drawn)})


def quick_mode(spark: SparkSession, c: C.QuickModeConfig) -> dict[str, str]:
    """Latent, scores, precomputed weights, and for each trait regression, regions and a page; what is there is kept."""
    layout = c.layout
    if not sinks.done(spark, layout.latent(c.sample_name)):
        find_latent(spark, C.LatentConfig(c.workdir, c.sample_name, c.input_path, c.annotation, c.data_layer, c.n_comps, graph=c.latent_representation == "latent_GVAE", pearson_residuals=c.pearson_residuals))
    if not sinks.done(spark, layout.gss(c.sample_name)):
        latent_to_gene(spark, C.LatentToGeneConfig(c.workdir, c.sample_name, c.annotation, c.latent_representation, c.num_neighbour, c.num_neighbour_spatial, c.homolog_file, c.gM_slices))
    if not sinks.done(spark, layout.ldscore(c.sample_name)):
        use_precomputed(spark, layout, c.sample_name, c.resource_dir)
    pages = {}
    for trait, path in c.sumstats.items():
        if not sinks.done(spark, layout.ldsc(c.sample_name, trait)):
            spatial_ldsc(spark, C.SpatialLDSCConfig(c.workdir, c.sample_name, path, trait))
        if not sinks.done(spark, layout.cauchy(c.sample_name, trait)):
            cauchy(spark, C.CauchyConfig(c.workdir, trait, c.annotation, c.sample_name))
        pages[trait] = report(spark, C.ReportConfig(c.workdir, c.sample_name, trait, c.annotation, path))
    return pages


def use_precomputed(spark: SparkSession, layout: C.Layout, sample: str, resource_dir: str, spots_per_chunk: int = 1000) -> None:
    """LD scores from tables made before for a panel: ``weights`` (chr, idx, snp, gene, w), ``baseline`` (chr, idx,
    snp, all_gene, base), ``snp_gene`` and ``w_ld`` (chr, snp, l2) in ``resource_dir``."""
    weights = spark.read.parquet(f"{resource_dir}/weights")
    scores = spark.read.parquet(layout.gss(sample))
    spots = spark.read.parquet(layout.spots(sample)).select("spot").distinct()
    order = in_chunks(spots, spots_per_chunk)
    arrays = ld.annotation_chunks(weights, scores, order).join(weights.select("chr", "idx", "snp").distinct(), ["chr", "idx"])
    sinks.write_table(spark.read.parquet(f"{resource_dir}/baseline"), layout.baseline(sample), "chr")
    sinks.write_table(spark.read.parquet(f"{resource_dir}/snp_gene"), layout.snp_gene(sample), "chr")
    sinks.write_table(spark.read.parquet(f"{resource_dir}/w_ld"), layout.weights(sample), "chr")
    sinks.write_table(order, layout.ldscore(sample) + "_spots")
    sinks.write_scores(arrays, layout.ldscore(sample))
