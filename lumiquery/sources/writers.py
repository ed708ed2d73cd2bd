"""Sinks: CSV, stable JSON, Markdown tables and partitioned predictions."""

from __future__ import annotations

import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

PREVIEW_ROWS = 1_000


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; quotes are doubled, as ``read_csv`` and other readers expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions in one folder for each target, model, split and seed, so reads prune by them."""
    df.write.mode("overwrite").partitionBy("target", "model", "split", "seed").parquet(path)


def _plain(x: Any) -> Any:
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    return x.item() if hasattr(x, "item") else x


def stable_json(value: Any) -> str:
    """Indented JSON with sorted keys; NaN and infinities are null."""
    return json.dumps(_plain(value), indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False)


def write_json(value: Any, path: str) -> None:
    """Write a small document."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(stable_json(value) + "\n", encoding="utf-8")


def number(x: Any, style: str = ".4f", missing: str = "") -> str:
    """A number in a report: ``.4f`` (with ``0`` trailing zeros go), ``.4g`` or ``.3g``; missing and infinite ones by name."""
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return missing
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x).replace("|", "\\|").replace("\n", " ")
    if isinstance(x, int):
        return str(x)
    trim = style.endswith("0")
    text = format(x, style.rstrip("0") if trim else style)
    return text.rstrip("0").rstrip(".") if trim and "." in text else text


def markdown_table(df: DataFrame, digits: int = 4, rows: int = PREVIEW_ROWS, styles: dict[str, str] | None = None, missing: str = "") -> str:
    """A report table of a small result. At most ``rows`` rows reach the driver; a last line says how many were left out.

    ``styles`` gives a column another number format than ``digits`` places without trailing zeros.
    """
    found = df.limit(rows + 1).collect()
    style = [(styles or {}).get(c, f".{digits}f0") for c in df.columns]
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(number(x, s, missing) for x, s in zip(r, style, strict=True)) + " |" for r in found[:rows]]
    if len(found) > rows:
        lines += ["", f"{df.count() - rows} more rows are not shown."]
    return "\n".join(lines)


def report(title: str, sections: list[tuple[str, str | DataFrame]]) -> str:
    """A Markdown report: a title, then headed paragraphs and tables."""
    parts = [f"# {title}"]
    for head, body in sections:
        parts += [f"## {head}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"
