"""Results as JSON envelopes, append logs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(command: str, status: Column, data: Column, errors: Column) -> Column:
    """One JSON object with its keys in alphabetical order."""
    return F.to_json(F.struct(F.lit(command).alias("command"), data.alias("data"), errors.alias("errors"), status.alias("status")))


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines; earlier ones stay."""
    rows.write.mode("append").json(path)


def report_text(aggregate: DataFrame, results: DataFrame, most: int = 1000) -> str:
    """An evaluation as text: the aggregate, then a line for each of the first ``most`` results by id."""
    row = aggregate.first()
    if row is None:
        return ""
    total = row.asDict()
    lines = ["=" * 70, f"EVAL REPORT ({total['queries']} queries)", "=" * 70, f"QS mean: {total['qs_mean']:.4f}  (min {total['qs_min']:.4f} / max {total['qs_max']:.4f})"]
    lines += [f"{k}: {v}" for k, v in total.items() if k not in ("queries", "qs_mean", "qs_min", "qs_max")]
    lines += ["", "Per-query breakdown:", "-" * 70]
    for r in results.orderBy("id").limit(most).collect():
        lines.append(f"{r['id']!s:20s} | QS {r['qs']:.3f} | route {'✓' if r['route_ok'] else '✗'} ({r['route']}/{r['expected_route']})")
    return "\n".join([*lines, "-" * 70])
