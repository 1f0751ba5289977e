"""A page of small tables, rendered on the driver."""

from __future__ import annotations

import html
import math
from datetime import datetime, timezone

import pandas as pd


# Colours of points, light to dark and by turns.
SCALE = ("#440154", "#3b528b", "#21918c", "#5ec962", "#fde725")
TURNS = ("#1b4f72", "#aed6f1")


def _svg(points: list[tuple[float, float, str, str]], width: int = 720, height: int = 360, line: float | None = None) -> str:
    """Points (x, y, colour, text) as SVG; a dashed line at a height."""
    if not points:
        return ""
    xs, ys = [p[0] for p in points], [p[1] for p in points] + ([line] if line is not None else [])
    span = lambda v: (min(v), (max(v) - min(v)) or 1.0)
    (x0, xw), (y0, yw) = span(xs), span(ys)
    at = lambda x, y: (10 + (width - 20) * (x - x0) / xw, height - 10 - (height - 20) * (y - y0) / yw)
    dots = "".join('<circle cx="{:.1f}" cy="{:.1f}" r="2" fill="{}"><title>{}</title></circle>'.format(*at(x, y), colour, html.escape(text)) for x, y, colour, text in points)
    rule = ""
    if line is not None:
        h = at(x0, line)[1]
        rule = f'<line x1="10" x2="{width - 10}" y1="{h:.1f}" y2="{h:.1f}" stroke="#999" stroke-dasharray="4"/>'
    return f'<svg viewBox="0 0 {width} {height}" xmlns="http://www.w3.org/2000/svg">{rule}{dots}</svg>'


def manhattan(table: pd.DataFrame, significant: float = 5e-8) -> str:
    """A picture of variants (x, p, chr, hover) along the chromosomes."""
    order = {c: k for k, c in enumerate(sorted(table["chr"].unique()))} if len(table) else {}
    return _svg([(r.x, -math.log10(max(r.p, 1e-300)), TURNS[order[r.chr] % 2], f"{r.snp} {r.hover}") for r in table.itertuples()], line=-math.log10(significant) if len(table) else None)


def scatter(table: pd.DataFrame, value: str) -> str:
    """A picture of spots (sx, sy) coloured by a value, clipped at its 99.99 % quantile."""
    v = table[value].clip(upper=table[value].quantile(0.9999)) if len(table) else table[value]
    low, wide = (v.min(), (v.max() - v.min()) or 1.0) if len(v) else (0, 1)
    return _svg([(x, y, SCALE[min(len(SCALE) - 1, int(len(SCALE) * (c - low) / wide))], f"{c:.4g}") for x, y, c in zip(table["sx"], table["sy"], v, strict=True)], height=720)


def render(title: str, tables: dict[str, pd.DataFrame], parameters: dict[str, str], pictures: dict[str, str] | None = None) -> str:
    """HTML of some tables of a few rows and of pictures, under their names."""

    def cell(v) -> str:
        return html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))

    def table(df: pd.DataFrame) -> str:
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in df.itertuples(index=False))
        return f"<table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table>"

    parts = [f"<h2>{html.escape(name)}</h2>{table(df)}" for name, df in tables.items()]
    parts += [f"<h2>{html.escape(name)}</h2>{svg}" for name, svg in (pictures or {}).items() if svg]
    told = "".join(f"<dt>{html.escape(k)}</dt><dd>{html.escape(str(v))}</dd>" for k, v in parameters.items())
    when = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M UTC")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{"".join(parts)}<dl>{told}</dl><p>{when}</p></body></html>'
