"""Sources, sinks, commands, and a whole analysis of a small sample."""

import gzip

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoloom import cli
from genoloom.plans import config as C
from genoloom.plans import steps
from genoloom.sources import arrow, plink, sinks, text
from genoloom.streaming.sumstats_stream import clean_stream, windowed_cauchy


def test_text_reader(spark, tmp_path):
    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(b"SNP  A1 A2 Z N\nrs1 A C 1.5 100\n  rs2 A C . 100\n\nrs1 A C 9 NA\n"))
    raw = text.read_gwas(spark, str(tmp_path / "g.txt.gz"))
    assert [tuple(r)[:5] for r in raw.orderBy("_seq").collect()] == [("rs1", "A", "C", "1.5", "100"), ("rs2", "A", "C", None, "100"), ("rs1", "A", "C", "9", None)]
    got = text.read_sumstats(spark, str(tmp_path / "g.txt.gz"), "t").orderBy("snp").collect()
    assert [(r["snp"], r["z"], r["n"], r["trait"]) for r in got] == [("rs1", 1.5, 100.0, "t"), ("rs2", None, 100.0, "t")]
    assert text.read_sumstats(spark, str(tmp_path / "g.txt.gz"), dropna=True).count() == 1
    with pytest.raises(ValueError, match="A3|no N|has no"):
        (tmp_path / "bad.txt").write_text("SNP P\nrs1 0.1\n")
        text.read_sumstats(spark, str(tmp_path / "bad.txt"))


def test_gtf_bed_annotation_homologs(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#c\n1\tx\tgene\t11\t20\t.\t-\t.\tgene_id "e"; gene_name "G1";\n1\tx\texon\t11\t20\t.\t+\t.\tgene_name "G2";\n')
    got = text.read_gtf(spark, str(tmp_path / "a.gtf")).orderBy("seq").collect()
    assert [(r["start"], r["end"], r["strand"], r["feature"], r["gene_name"]) for r in got] == [(10, 20, "-", "gene", "G1"), (10, 20, "+", "exon", "G2")]
    (tmp_path / "e.bed").write_text("chr1\t5\t9\tG1\nchr1\t6\t9\tG2\n")
    assert [(r["start"], r["gene"]) for r in text.read_bed(spark, str(tmp_path / "e.bed")).orderBy("seq").collect()] == [(5, "G1"), (6, "G2")]
    (tmp_path / "x.annot").write_text("CHR\tBP\tSNP\tCM\tq\tr\n1\t2\trs1\t0\t1\t0.5\n")
    assert {(r["name"], r["value"]) for r in text.read_annotation(spark, str(tmp_path / "x.annot")).collect()} == {("q", 1.0), ("r", 0.5)}
    (tmp_path / "h.tsv").write_text("mouse\thuman\textra\nm\th\tx\n")
    with pytest.raises(ValueError, match="two columns"):
        text.read_homologs(spark, str(tmp_path / "h.tsv"))
    (tmp_path / "w.txt").write_text("CHR SNP BP CM L2\n1 rs1 5 0 2.5\n")
    assert text.read_weights(spark, str(tmp_path / "w.txt")).select("snp", "l2").collect() == [("rs1", 2.5)]


def packed(calls: np.ndarray) -> bytes:
    codes = np.select([calls == 0, calls == 9, calls == 1], [0, 1, 2], 3).astype(np.uint8)
    pad = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))
    four = pad.reshape(len(calls), -1, 4)
    return plink.MAGIC + (four << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8).tobytes()


def test_genotypes(spark, tmp_path):
    calls = np.random.default_rng(0).choice([0, 1, 2, 9], (13, 6))
    (tmp_path / "p.bed").write_bytes(packed(calls))
    for df in (plink.read_bed(spark, str(tmp_path / "p.bed"), 6, 13, 4, rows=5), plink.read_bed_files(spark, str(tmp_path / "p.bed"), 6, 4)):
        got = df.orderBy("idx").collect()
        assert np.array_equal([r["g"] for r in got], calls) and {r["chr"] for r in got} == {4}
    with pytest.raises(Exception, match="does not hold"):
        plink.read_bed(spark, str(tmp_path / "p.bed"), 6, 14).collect()


def test_feather(spark, tmp_path):
    t = pa.table({"HUMAN_GENE_SYM": ["a", "b"], "s1": pa.array(np.array([1, 0], np.float16)), "s2": pa.array(np.array([0.5, 2], np.float16))})
    with pa.OSFile(str(tmp_path / "x.feather"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert sorted(map(tuple, arrow.read_feather(spark, str(tmp_path / "x.feather"), ("gene", "spot", "score")).collect())) == [("a", "s1", 1.0), ("a", "s2", 0.5), ("b", "s2", 2.0)]
    assert text.read_any(spark, str(tmp_path / "x.feather")).orderBy("HUMAN_GENE_SYM").first()["s2"] == 0.5


def test_sumstats_text(spark, tmp_path):
    sinks.write_sumstats(spark.createDataFrame([("rs1", 1.23456)], "SNP string, Z double"), str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), sep="\t", header=True).collect() == [("rs1", "1.235")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("rs1", "a", "C", 0.1), ("rs2", "A", "T", 0.1), ("rs3", "A", "G", 0.0)], "SNP string, A1 string, A2 string, P double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("SNP string, A1 string, A2 string, P double").parquet(str(tmp_path / "in"))
    q = clean_stream(stream).writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["SNP"] for r in spark.sql("select * from cleaned").collect()] == ["rs1"]
    e = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as k, 0.5D as p union all select timestamp'2024-01-01 05:00:00', 'a', 0.2D")
    assert windowed_cauchy(e, "ts", "k", "p").count() == 2


def test_commands():
    c, step, _ = cli.make("run_spatial_ldsc --workdir w --sample_name s --sumstats_file f --trait_name t --use_additional_baseline_annotation false --chunk_range 1 3".split())
    assert c.sumstats == {"t": "f"} and c.use_additional_baseline_annotation is False and c.chunk_range == (1, 3) and step is steps.spatial_ldsc
    c, _, _ = cli.make("create_slice_mean --slice_mean_output_file o --expression_paths a=x b=y".split())
    assert c.expression_paths == {"a": "x", "b": "y"}
    assert len(cli.COMMANDS) == 9
    with pytest.raises(ValueError, match="either"):
        cli.make("run_cauchy_combination --workdir w --trait_name t".split())
    with pytest.raises(ValueError, match="together"):
        C.ReportConfig("w", "s", fig_width=3)
    assert C.LDScoreConfig("w", "s", enhancer_annotation_file="e").gene_window_enhancer_priority == "enhancer_only"
    assert C.LDScoreConfig("w", "s", gene_window_enhancer_priority="gene_window_first").gene_window_enhancer_priority is None
    with pytest.raises(ValueError, match="1 to 22"):
        C.LDScoreConfig("w", "s", chrom="23")


def test_mapping_file(tmp_path):
    (tmp_path / "t.yaml").write_text("# traits\nIQ: /a/b.gz\n'height': \"/c:d\" # note\n")
    assert C.read_mapping(str(tmp_path / "t.yaml")) == {"IQ": "/a/b.gz", "height": "/c:d"}


def test_whole_analysis(spark, tmp_path):
    rng = np.random.default_rng(5)
    spots, genes, people, variants = 60, 12, 20, 240
    x = rng.poisson(2, (spots, genes))
    rows = [(f"c{i}", f"G{j}", float(x[i, j])) for i in range(spots) for j in range(genes) if x[i, j]]
    spark.createDataFrame(rows, "spot string, gene string, value double").write.parquet(str(tmp_path / "in/expression"))
    place = [(f"c{i}", i, float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(spots)]
    spark.createDataFrame(place, "spot string, pos long, sx double, sy double, region string").write.parquet(str(tmp_path / "in/spots"))
    work = str(tmp_path / "work")
    steps.find_latent(spark, C.LatentConfig(work, "S", str(tmp_path / "in"), "region", n_comps=4, feat_cell=10, epochs=5))
    assert {r["rep"] for r in spark.read.parquet(C.Layout(work).latent("S")).select("rep").distinct().collect()} == {"latent_PCA", "latent_GVAE"}
    steps.latent_to_gene(spark, C.LatentToGeneConfig(work, "S", "region", num_neighbour=5, num_neighbour_spatial=10))
    (tmp_path / "g.gtf").write_text("".join(f'1\tx\tgene\t{1 + j * 20000}\t{10000 + j * 20000}\t.\t+\t.\tgene_name "G{j}";\n' for j in range(genes)))
    (tmp_path / "p.1.bim").write_text("".join(f"1\trs{i}\t0\t{1 + i * 1000}\tA\tC\n" for i in range(variants)))
    (tmp_path / "p.1.fam").write_text("".join(f"f{i} i{i} 0 0 0 -9\n" for i in range(people)))
    (tmp_path / "p.1.bed").write_bytes(packed(rng.choice([0, 1, 2], (variants, people))))
    (tmp_path / "keep.1.snp").write_text("".join(f"rs{i}\n" for i in range(0, variants, 2)))
    steps.generate_ldscore(spark, C.LDScoreConfig(work, "S", "1", str(tmp_path / "p"), str(tmp_path / "g.gtf"), str(tmp_path / "keep"), gene_window_size=3000, spots_per_chunk=25, ld_wind=0.05))
    layout = C.Layout(work)
    assert spark.read.parquet(layout.ldscore("S")).select("chunk").distinct().count() == 3
    assert spark.read.parquet(layout.weights("S")).count() == variants // 2
    m = spark.read.parquet(layout.ldscore("S") + "_m").agg(F.sum("m").alias("a"), F.sum("m_5_50").alias("b")).first()
    assert m["a"] >= m["b"] > 0
    assert text.read_weights(spark, layout.weights("S") + "_text").count() == variants // 2
    (tmp_path / "t.sumstats").write_text("SNP A1 A2 Z N\n" + "".join(f"rs{i} A C {rng.normal() * 1.5:.3f} 1000\n" for i in range(variants)))
    out = steps.spatial_ldsc(spark, C.SpatialLDSCConfig(work, "S", str(tmp_path / "t.sumstats"), "T", n_blocks=10))
    assert text.read_result(spark, layout.ldsc("S", "T") + "_text").count() == out.count()
    assert 0 < out.count() <= spots and {"spot", "beta", "se", "z", "p", "trait"} <= set(out.columns)
    found = steps.cauchy(spark, C.CauchyConfig(work, "T", "region", "S"))
    assert {r["annotation"] for r in found.collect()} == {"a", "b"}
    page = steps.report(spark, C.ReportConfig(work, "S", "T", "region", str(tmp_path / "t.sumstats"), 5))
    assert "<h2>Genes</h2>" in page and "<h2>Regions</h2>" in page and page.count("<svg") == 2
    # quick mode: precomputed tables, and everything that is there already is kept
    res = tmp_path / "res"
    name = spark.read.parquet(layout.snp_gene("S")).select("chr", "idx", "snp")
    spark.read.parquet(layout.baseline("S") + "_weights").join(name, ["chr", "idx"]).write.parquet(str(res / "weights"))
    for a, b in (("baseline", layout.baseline("S")), ("snp_gene", layout.snp_gene("S")), ("w_ld", layout.weights("S"))):
        spark.read.parquet(b).write.parquet(str(res / a))
    spark.read.parquet(layout.spots("S")).write.parquet(str(tmp_path / "q/S2/unused"))
    pages = steps.quick_mode(spark, C.QuickModeConfig(work, "S", str(res), str(tmp_path / "in"), "region", sumstats_file=str(tmp_path / "t.sumstats"), trait_name="T2"))
    assert set(pages) == {"T2"}
    assert spark.read.parquet(layout.ldsc("S", "T2")).agg(F.count("*")).first()[0] == out.count()
    mean = steps.create_slice_mean(spark, C.SliceMeanConfig(str(tmp_path / "mean"), {"x": str(tmp_path / "in"), "y": str(tmp_path / "in")}))
    assert mean.count() == genes


def test_format_step(spark, tmp_path):
    pd.DataFrame({"RSID": ["rs1", "rs2"], "EA": ["A", "A"], "NEA": ["C", "T"], "b": [0.1, 0.2], "se": [0.1, 0.1], "WEIGHT": [10, 10]}).to_csv(tmp_path / "raw.txt", sep=" ", index=False)
    out = steps.format_sumstats(spark, C.FormatSumstatsConfig(str(tmp_path / "raw.txt"), str(tmp_path / "o"), n="500"))
    got = out.collect()
    assert [(r["SNP"], r["N"]) for r in got] == [("rs1", 500.0)] or [(r["SNP"]) for r in got] == ["rs1"]
