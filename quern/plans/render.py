"""Markdown and TeX from small result tables, and data of plots.

Only aggregated tables come here: a row for each source, model or threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..functions.texts import TEX_ESCAPES


def number(x: object, digits: int = 3) -> str:
    if x is None:
        return "--"
    return f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def percent(rate: float | None, lower: float | None = None, upper: float | None = None) -> str:
    """``12.3% [10.0, 14.9]``; an en dash for an empty group."""
    if rate is None:
        return "–"
    return f"{100 * rate:.1f}%" + (f" [{100 * lower:.1f}, {100 * upper:.1f}]" if lower is not None and upper is not None else "")


def tex(text: str) -> str:
    return "".join(TEX_ESCAPES.get(c, c) for c in text)


def table(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, cell: Callable[[object], str] = number) -> str:
    """A Markdown table in a steady order."""
    columns = list(columns or df.columns)
    rows = df.orderBy(*order).select(*columns).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def tex_table(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None) -> str:
    columns = list(columns or df.columns)
    rows = df.orderBy(*order).select(*columns).collect()
    body = [" & ".join(tex(number(v)) for v in r) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(map(tex, columns)) + r" \\", r"\hline", *body, r"\end{tabular}"])


def detector_markdown(name: str, report: dict[str, DataFrame]) -> str:
    """One detector: overall figures, sources, gates, best thresholds."""
    failed = [r["message"] for r in report["gates"].orderBy("source").collect()]
    return "\n\n".join([
        f"# {name}", "## Overall", table(report["overall"], ["n"]), "## Sources", table(report["sources"], ["source"]),
        "## Gates", "\n".join(f"- {m}" for m in failed) or "All gates pass.", "## Best F1", table(report["best"], ["threshold"]),
        "## Within the FPR limit", table(report["constrained"], ["threshold"]),
    ]) + "\n"


def comparison_markdown(wide: DataFrame, source: str, models: Sequence[str], bad: Callable[[str, float], bool]) -> str:
    """Sources by models; values beyond their gate are bold."""
    lines = ["| source | " + " | ".join(models) + " |", "|" + "---|" * (len(models) + 1)]
    for r in wide.orderBy(source).collect():
        cells = [("**%s**" if r[m] is not None and bad(r[source], r[m]) else "%s") % number(r[m]) for m in models]
        lines.append(f"| {r[source]} | " + " | ".join(cells) + " |")
    return "\n".join(lines) + "\n"


def rate_markdown(title: str, blocks: DataFrame, keys: Sequence[str]) -> str:
    """Rate blocks with their intervals."""
    rows = blocks.orderBy(*keys).collect()
    lines = ["| " + " | ".join(keys) + " | n | rate |", "|" + "---|" * (len(keys) + 2)]
    lines += ["| " + " | ".join(str(r[k]) for k in keys) + f" | {r['n']} | {percent(r['rate'], r['lower'], r['upper'])} |" for r in rows]
    return f"## {title}\n\n" + "\n".join(lines) + "\n"


def curve(sweep: DataFrame) -> list[tuple[float, float, float]]:
    """``(fpr, tpr, threshold)`` of a sweep, for a plot."""
    return [(r["fpr"], r["tpr"], r["threshold"]) for r in sweep.orderBy("threshold").collect()]
