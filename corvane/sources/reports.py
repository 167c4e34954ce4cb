"""Benchmark results as JSON, Markdown, CSV or console text."""

from __future__ import annotations

import csv
import io
import json
from pathlib import Path

COLUMNS = ("algorithm", "n", "k", "ef_search", "recall_mean", "recall_std", "mean_ms", "qps", "speedup")


def _cells(row: dict) -> list[str]:
    return ["" if row[c] is None else f"{row[c]:.4g}" if isinstance(row[c], float) else str(row[c]) for c in COLUMNS]


def to_json(results, path: str | Path | None = None) -> str:
    text = json.dumps(results.to_dict(), indent=2)
    if path:
        Path(path).write_text(text, encoding="utf-8")
    return text


def to_table(results, form: str = "markdown") -> str:
    if form == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([COLUMNS, *(_cells(r) for r in results.rows)])
        return out.getvalue()
    if form != "markdown":
        raise ValueError("form must be markdown or csv")
    lines = [COLUMNS, ["-"] * len(COLUMNS), *(_cells(r) for r in results.rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def console(results) -> str:
    c = results.config
    head = f"{c.n_vectors} vectors of {c.dimension} dimensions, {c.n_queries} queries, {c.metric}"
    built = ", ".join(f"{k} {v:.2f} s" for k, v in results.build_seconds.items())
    return f"{head}\nbuilt: {built}\n{to_table(results)}"


def comparison(all_results: list) -> str:
    best = [(r.config.n_vectors, max((x for x in r.rows if x["algorithm"] == "hnsw"), key=lambda x: (x["recall_mean"], x["speedup"]))) for r in all_results]
    return "\n".join(f"n={n}: best recall {x['recall_mean']:.3f} at k={x['k']}, ef={x['ef_search']}, speedup {x['speedup']:.2f}" for n, x in best)
