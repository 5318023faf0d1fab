"""Report tables: best values marked, two runs side by side. All are grids of a fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import score as S
from ..operators.select import bins


def percent(x: Column) -> Column:
    return F.format_string("%.1f", x * 100)


def bold(text: Column, when: Column) -> Column:
    return F.when(when, F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)


def score_table(runs: DataFrame, metrics: list[str], name: str = "run") -> DataFrame:
    """Percentages of each run; the best of a column is bold, all of them at a tie. One row a run."""
    whole = Window.partitionBy(F.lit(0))
    return runs.select(name, *(bold(percent(F.col(m)), F.col(m) == F.max(m).over(whole)).alias(m) for m in metrics))


def shift_table(base: DataFrame, tuned: DataFrame, cells: DataFrame, row: str = "kind", column: str = "judged") -> DataFrame:
    """``b → t`` for each cell of the grid, 0 where a run has none; the diagonal is bold."""
    keys = [row, column]
    sides = cells.join(base.select(*keys, F.col("n").alias("_b")), keys, "left").join(tuned.select(*keys, F.col("n").alias("_t")), keys, "left")
    text = F.format_string("%d → %d", F.coalesce("_b", F.lit(0)), F.coalesce("_t", F.lit(0)))
    return sides.select(*keys, bold(text, F.col(row) == F.col(column)).alias("cell"))


def histogram_label(kind: Column, score: Column) -> Column:
    """``kind@score`` with the score as short as it goes: 0, 0.5, 1."""
    return F.concat(kind, F.lit("@"), F.regexp_replace(F.format_string("%.6f", score), r"\.?0+$", ""))


def latex(rows: list[list[str]], header: list[str]) -> str:
    """A table's lines; bold marks become the command."""
    cell = lambda s: rf"\textbf{{{s[2:-2]}}}" if s.startswith("**") else s
    lines = [" & ".join(map(cell, r)) + r" \\" for r in [header, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' + 'r' * (len(header) - 1)}}}", *lines, r"\end{tabular}"])


# What columns are called, and how a summary is told.
METRIC = {"answer": "C", "repair": "R", "repeat": "F"}
# End of fixed values.


def typed_bins(rows: DataFrame, level: str, judged: str, edges: list[float], types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(counts, clean): counts by bin of the level and judged type on the whole grid, 0 where there are none; and the rows without a level, which are not in it."""
    grid = S.grid(rows.sparkSession, bin=list(range(len(edges) - 1)), judged=types)
    found = rows.where(F.col(level).isNotNull()).groupBy(bins(F.col(level), edges).cast("long").alias("bin"), F.col(judged).alias("judged")).agg(F.count("*").alias("n"))
    counts = F.broadcast(grid).join(found, ["bin", "judged"], "left").select("bin", "judged", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return counts, rows.where(F.col(level).isNull())


def family(scores: list[list[str]], shifts: list[list[str]], metrics: list[str], types: list[str], label: str) -> str:
    """One float with two tables beside each other: the scores of two runs, and how judged types moved between them."""
    half = lambda body: "\n".join([r"\begin{minipage}{0.48\linewidth}", body, r"\end{minipage}"])
    return "\n".join([r"\begin{table}[t]", half(latex(scores, ["run", *metrics])), r"\hfill", half(latex(shifts, ["kind", *types])), rf"\label{{{label}}}", r"\end{table}"])


def console(summary: DataFrame, cells: DataFrame, kinds: list[str], model: str, per_kind: bool = False) -> str:
    """The end of a run as text: rows and means of each kind, failures, and the confusion (or, judged by kind, the scores), from one row and a grid's cells (kind, label, n)."""
    total = summary.first().asDict()
    n = sum(total[f"{k}_rows"] for k in kinds)
    lines = [f"Final Eval - {model} ({' / '.join(f'{total[f"{k}_rows"]} {k}' for k in kinds)} rows)"]
    lines += [f"{METRIC[k]}  : {total[METRIC[k]]: .3f}" for k in kinds] + [f"EAR: {total['EAR']: .3f}"]
    told = {"heard_parse_failures": "heard-parse failures: {}/{} (judged on raw output)", "judge_parse_failures": "judge parse failures: {}/{} (scored 0)", "unanswered_rows": "without an answer: {}/{} (not scored)"}
    lines += [text.format(total[name], n) for name, text in told.items() if total.get(name)]
    found: dict[str, list[str]] = {}
    for r in cells.orderBy("kind", "label").collect():  # a grid's cells
        found.setdefault(r["kind"], []).append(f"{r['label']}:{r['n']:3d}")
    lines.append("scores per kind:" if per_kind else "confusion (target kind -> judged type):")
    return "\n".join(lines + [f"  {k:8s} {' '.join(found.get(k, []))}" for k in kinds])


def arguments(text: str) -> dict[str, int]:
    """``kind=n`` pairs between commas; ValueError for an unknown kind or what is no number."""
    out = {}
    for part in text.split(","):
        kind, _, n = part.partition("=")
        if kind.strip() not in S.KINDS:
            raise ValueError(f"unknown kind {kind.strip()!r} in {text!r}")
        out[kind.strip()] = int(n)
    return out


def shortfall(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(kind, missing) of the caps that the rows do not fill."""
    asked = rows.sparkSession.createDataFrame(list(caps.items()), "kind string, wanted long")
    have = rows.groupBy("kind").agg(F.count("*").alias("n"))
    missing = F.col("wanted") - F.coalesce("n", F.lit(0))
    return F.broadcast(asked).join(have, "kind", "left").select("kind", missing.alias("missing")).where("missing > 0")
