"""Sub-commands: ``python -m genoloom.cli NAME --option value``; options are the fields of a step's config."""

from __future__ import annotations

import argparse
import dataclasses
import sys
import typing

from .plans import config as C
from .plans import steps
from .session import build

COMMANDS = {
    "quick_mode": (C.QuickModeConfig, steps.quick_mode),
    "run_find_latent_representations": (C.LatentConfig, steps.find_latent),
    "run_latent_to_gene": (C.LatentToGeneConfig, steps.latent_to_gene),
    "run_generate_ldscore": (C.LDScoreConfig, steps.generate_ldscore),
    "run_spatial_ldsc": (C.SpatialLDSCConfig, steps.spatial_ldsc),
    "run_cauchy_combination": (C.CauchyConfig, steps.cauchy),
    "run_report": (C.ReportConfig, steps.report),
    "format_sumstats": (C.FormatSumstatsConfig, steps.format_sumstats),
    "create_slice_mean": (C.SliceMeanConfig, steps.create_slice_mean),
}


def _truth(v: str) -> bool:
    if v.lower() in ("true", "yes", "1"):
        return True
    if v.lower() in ("false", "no", "0"):
        return False
    raise argparse.ArgumentTypeError(f"{v} is neither true nor false")


def _pair(v: str) -> tuple[str, str]:
    key, eq, value = v.partition("=")
    if not eq:
        raise argparse.ArgumentTypeError(f"{v} is not name=value")
    return key, value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="genoloom")
    top.add_argument("--master")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (cls, _) in COMMANDS.items():
        p = sub.add_parser(name)
        hints = typing.get_type_hints(cls)
        for f in dataclasses.fields(cls):
            kinds = [t for t in typing.get_args(hints[f.name]) if t is not type(None)] or [hints[f.name]]
            kind = kinds[0] if typing.get_origin(hints[f.name]) not in (list, dict, tuple) else hints[f.name]
            missing = f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
            how: dict = {"required": missing}
            if typing.get_origin(kind) is list:
                how["nargs"] = "+"
            elif kind is dict or typing.get_origin(kind) is dict:
                how |= {"nargs": "+", "type": _pair}
            elif typing.get_origin(kind) is tuple:
                how |= {"nargs": 2, "type": int}
            else:
                how["type"] = _truth if kind is bool else kind
            p.add_argument(f"--{f.name}", **how)
    return top


def make(argv: list[str]):
    """The config and step of some arguments."""
    args = vars(parser().parse_args(argv))
    cls, step = COMMANDS[args["command"]]
    hints = typing.get_type_hints(cls)
    values = C.known(cls, args)
    for k, v in values.items():
        if isinstance(v, list) and v and isinstance(v[0], tuple):
            values[k] = dict(v)
        elif typing.get_origin(hints[k]) is tuple or any(typing.get_origin(t) is tuple for t in typing.get_args(hints[k])):
            values[k] = tuple(v)
    return cls(**values), step, args["master"]


def main(argv: list[str] | None = None) -> int:
    config, step, master = make(sys.argv[1:] if argv is None else argv)
    out = step(build(master), config)
    if isinstance(out, str):
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
