"""Small results as text: tables, CSV, bars. Rows are few here and come to the driver."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame


def _rows(df: DataFrame, columns: list[str], order: list[str]) -> list[list[str]]:
    text = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return [[text(r[c]) for c in columns] for r in df.select(*columns).orderBy(*order).collect()]


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in _rows(df, columns, order)]) + "\n"


def csv_text(df: DataFrame, columns: list[str], order: list[str]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(_rows(df, columns, order))
    return out.getvalue()


def bar_chart(df: DataFrame, category: str, series: list[str], width: int = 640, height: int = 320) -> str:
    """Grouped bars of up to three measures between 0 and 1 as SVG."""
    if not 1 <= len(series) <= 3:
        raise ValueError("one to three series")
    rows = df.select(category, *series).orderBy(category).collect()
    colours = ["#4269d0", "#efb118", "#3ca951"]
    step = (width - 60) / max(1, len(rows))
    bar = step * 0.8 / len(series)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img">']
    for i, row in enumerate(rows):
        for j, name in enumerate(series):
            value = max(0.0, min(1.0, float(row[name] or 0)))
            h = (height - 60) * value
            parts.append(f'<rect x="{50 + i * step + j * bar:.1f}" y="{height - 40 - h:.1f}" width="{bar * 0.9:.1f}" height="{h:.1f}" fill="{colours[j]}"><title>{row[category]} {name} {value:.3f}</title></rect>')
        label = str(row[category]).replace("&", "&amp;").replace("<", "&lt;")
        parts.append(f'<text x="{50 + i * step + step * 0.4:.1f}" y="{height - 22}" font-size="11" text-anchor="middle">{label}</text>')
    parts += [f'<text x="{60 + j * 140}" y="16" font-size="12" fill="{colours[j]}">{name}</text>' for j, name in enumerate(series)]
    return "\n".join([*parts, "</svg>"]) + "\n"
