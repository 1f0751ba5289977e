"""What each step is told, checked on the driver, and where its tables are."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import PurePosixPath


@dataclass(frozen=True)
class Layout:
    """Where the tables of a work folder are."""

    workdir: str

    def _at(self, *parts: str) -> str:
        return str(PurePosixPath(self.workdir.replace("://", "\x00"), *parts)).replace("\x00", "://")

    def latent(self, sample: str) -> str:
        return self._at(sample, "latent")

    def spots(self, sample: str) -> str:
        return self._at(sample, "spots")

    def expression(self, sample: str) -> str:
        return self._at(sample, "expression")

    def gss(self, sample: str) -> str:
        return self._at(sample, "gss")

    def snp_gene(self, sample: str) -> str:
        return self._at(sample, "snp_gene")

    def baseline(self, sample: str) -> str:
        return self._at(sample, "baseline")

    def weights(self, sample: str) -> str:
        return self._at(sample, "w_ld")

    def ldscore(self, sample: str) -> str:
        return self._at(sample, "ldscore")

    def ldsc(self, sample: str, trait: str) -> str:
        return self._at(sample, "ldsc", trait)

    def cauchy(self, sample: str, trait: str) -> str:
        return self._at(sample, "cauchy", trait)

    def report(self, sample: str, trait: str) -> str:
        return self._at(sample, "report", trait)


@dataclass
class SampleStep:
    workdir: str
    sample_name: str

    @property
    def layout(self) -> Layout:
        return Layout(self.workdir)


@dataclass
class LatentConfig(SampleStep):
    input_path: str = ""
    annotation: str | None = None
    data_layer: str = "count"
    n_comps: int = 300
    feat_cell: int = 3000
    pearson_residuals: bool = False
    graph: bool = True
    input_pca: bool = True
    epochs: int = 300
    feat_hidden1: int = 256
    feat_hidden2: int = 128
    gat_hidden1: int = 64
    gat_hidden2: int = 30
    nheads: int = 3
    p_drop: float = 0.1
    gat_lr: float = 0.001
    gcn_decay: float = 0.01
    n_neighbors: int = 11
    label_w: float = 1.0
    rec_w: float = 1.0
    convergence_threshold: float = 1e-4
    seed: int = 2024

    def __post_init__(self):
        if not self.input_path:
            raise ValueError("input_path is needed")


@dataclass
class LatentToGeneConfig(SampleStep):
    annotation: str | None = None
    latent_representation: str = "latent_GVAE"
    num_neighbour: int = 21
    num_neighbour_spatial: int = 101
    homolog_file: str | None = None
    gM_slices: str | None = None
    no_expression_fraction: bool = False

    def __post_init__(self):
        if not 0 < self.num_neighbour <= self.num_neighbour_spatial:
            raise ValueError("num_neighbour is between 1 and num_neighbour_spatial")


@dataclass
class LDScoreConfig(SampleStep):
    chrom: str = "all"
    bfile_root: str = ""
    gtf_annotation_file: str = ""
    keep_snp_root: str | None = None
    gene_window_size: int = 50_000
    enhancer_annotation_file: str | None = None
    snp_multiple_enhancer_strategy: str = "max_mkscore"
    gene_window_enhancer_priority: str | None = None
    spots_per_chunk: int = 1000
    ld_wind: float = 1.0
    ld_unit: str = "CM"
    additional_baseline_annotation: str | None = None

    def __post_init__(self):
        if self.enhancer_annotation_file and self.gene_window_enhancer_priority is None:
            self.gene_window_enhancer_priority = "enhancer_only"
        if not self.enhancer_annotation_file:
            self.gene_window_enhancer_priority = None
        if self.gene_window_enhancer_priority not in (None, "gene_window_first", "enhancer_first", "enhancer_only"):
            raise ValueError(f"unknown priority {self.gene_window_enhancer_priority}")
        if self.snp_multiple_enhancer_strategy not in ("max_mkscore", "nearest_TSS"):
            raise ValueError(f"unknown strategy {self.snp_multiple_enhancer_strategy}")
        if self.ld_unit not in ("SNP", "KB", "CM"):
            raise ValueError(f"unknown unit {self.ld_unit}")
        self.chromosomes()

    def chromosomes(self) -> list[int]:
        if self.chrom == "all":
            return list(range(1, 23))
        if not (str(self.chrom).isdigit() and 1 <= int(self.chrom) <= 22):
            raise ValueError("chrom is a number from 1 to 22, or all")
        return [int(self.chrom)]


def traits(file: str | None, name: str | None, config: str | None) -> dict[str, str]:
    """Trait to path, from one file and name or from a mapping file (name: path by line)."""
    if (file is None) == (config is None):
        raise ValueError("either a sumstats file or a config file is needed")
    if file is not None:
        if not name:
            raise ValueError("a sumstats file needs a trait_name")
        return {name: file}
    return read_mapping(config)


def read_mapping(path: str) -> dict[str, str]:
    """A flat mapping, as JSON or as ``key: value`` lines."""
    text = open(path).read()
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out = {}
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if line and not line.startswith("#"):
            key, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"{path}: {line}")
            out[key.strip().strip("'\"")] = value.strip().strip("'\"")
    return out


@dataclass
class SpatialLDSCConfig(SampleStep):
    sumstats_file: str | None = None
    trait_name: str | None = None
    sumstats_config_file: str | None = None
    w_file: str | None = None
    n_blocks: int = 200
    chisq_max: float | None = None
    use_additional_baseline_annotation: bool = True
    chunk_range: tuple[int, int] | None = None
    shared_snps: bool = True

    def __post_init__(self):
        self.sumstats = traits(self.sumstats_file, self.trait_name, self.sumstats_config_file)
        if self.chunk_range and not 1 <= self.chunk_range[0] <= self.chunk_range[1]:
            raise ValueError("chunk_range is two numbers from 1, in order")


@dataclass
class CauchyConfig:
    workdir: str
    trait_name: str
    annotation: str = "annotation"
    sample_name: str | None = None
    sample_name_list: list[str] = field(default_factory=list)
    output_file: str | None = None

    def __post_init__(self):
        if bool(self.sample_name) == bool(self.sample_name_list):
            raise ValueError("either sample_name or sample_name_list is needed")
        if self.sample_name_list and not self.output_file:
            raise ValueError("sample_name_list needs an output_file")

    @property
    def samples(self) -> list[str]:
        return [self.sample_name] if self.sample_name else list(self.sample_name_list)


@dataclass
class ReportConfig(SampleStep):
    trait_name: str = ""
    annotation: str = "annotation"
    sumstats_file: str = ""
    top_corr_genes: int = 50
    selected_genes: list[str] = field(default_factory=list)
    fig_width: int | None = None
    fig_height: int | None = None
    point_size: int | None = None

    def __post_init__(self):
        given = [v is not None for v in (self.fig_width, self.fig_height, self.point_size)]
        if any(given) and not all(given):
            raise ValueError("fig_width, fig_height and point_size come together")


@dataclass
class FormatSumstatsConfig:
    sumstats: str
    out: str
    dbsnp: str | None = None
    format: str = "sumstats"
    info_min: float = 0.9
    maf_min: float = 0.01
    n: str | None = None
    keep_chr_pos: bool = False
    names: dict = field(default_factory=dict)


@dataclass
class SliceMeanConfig:
    slice_mean_output_file: str
    expression_paths: dict[str, str] = field(default_factory=dict)
    homolog_file: str | None = None

    def __post_init__(self):
        if len(self.expression_paths) < 2:
            raise ValueError("a mean over slices needs two samples at least")


@dataclass
class QuickModeConfig(SampleStep):
    resource_dir: str = ""
    input_path: str = ""
    annotation: str = "annotation"
    data_layer: str = "count"
    latent_representation: str = "latent_GVAE"
    sumstats_file: str | None = None
    trait_name: str | None = None
    sumstats_config_file: str | None = None
    homolog_file: str | None = None
    gM_slices: str | None = None
    num_neighbour: int = 21
    num_neighbour_spatial: int = 101
    n_comps: int = 300
    pearson_residuals: bool = False

    def __post_init__(self):
        self.sumstats = traits(self.sumstats_file, self.trait_name, self.sumstats_config_file)


def known(cls, values: dict) -> dict:
    """Of some arguments those that a config has, without those left out."""
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in values.items() if k in names and v is not None}
