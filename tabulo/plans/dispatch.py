"""Question -> chart dispatch and the automatic dashboard (Q04-Q06).

Each question becomes one chart object (``charts``); all charts of a call are drawn together, from two scans of the pruned
input whatever their number, into one tidy frame ``(qid, chart, series, x, y, x_lo, x_hi, extra)`` keyed by question id (the
reference pairs files by list index, F9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import agg as A
from . import charts as C
from . import questions as Q


def kinds_of(prof_rows) -> dict:
    rows = sorted(prof_rows, key=lambda r: r["ordinal"])
    return {
        "num": [r["column"] for r in rows if r["kind"] == "num" and r["nunique"] > 1],
        "cat": [r["column"] for r in rows if r["kind"] == "cat" and r["nunique"] > 1],
        "date": [r["column"] for r in rows if r["kind"] == "date"],
    }


def two_way(column: str, prof_rows, chart: str, top_n: int = 10) -> C.Chart:
    """Crossed with the first other category of 2-5 labels when one exists."""
    second = A.second_dimension(prof_rows, column, 2, 5)
    return C.Cross(column, second, chart, first=top_n) if second else C.TwoWay(column, chart, top_n)


def means(category: str, number: str, prof_rows) -> C.Chart:
    """By a second category of 2-7 labels when one exists."""
    return C.Means(category, number, A.second_dimension(prof_rows, category, 2, 7))


def chart_for_question(q: dict, prof_rows, policy: str = "chart") -> C.Chart | None:
    """Q04 (``policy='chart'``: chart type + column kinds) and Q05
    (``policy='dtype'``: kinds only; adds category x category)."""
    kind = {c: name for name, cols in kinds_of(prof_rows).items() for c in cols}
    cols = q["columns"]
    of = [kind.get(c) for c in cols]
    if len(cols) == 1:
        (c,), (k,) = cols, of
        if policy == "dtype":
            return C.Histogram(c, "histogram", 20) if k == "num" else C.Top(c, 12)
        if k == "num":
            return C.Box(c) if q["chart"] == "box" else C.Histogram(c)
        return two_way(c, prof_rows, q["chart"]) if k == "cat" else C.Periods(c) if k == "date" else None
    if len(cols) == 2:
        by = dict(zip(of, cols))
        if of == ["num", "num"]:
            return C.Trend(*cols)
        if set(of) == {"cat", "num"}:
            return C.Means(by["cat"], by["num"], named=True) if policy == "dtype" else means(by["cat"], by["num"], prof_rows)
        if set(of) == {"date", "num"} and policy == "chart":
            return C.Line(by["date"], by["num"])
        if of == ["cat", "cat"] and policy == "dtype":
            return C.Cross(*cols)
    return None


def answer_questions(df: DataFrame, questions, prof_rows, policy: str = "chart") -> DataFrame:
    found = ((q["qid"], chart_for_question(q, prof_rows, policy)) for q in questions)
    return C.draw(df, [(qid, chart) for qid, chart in found if chart is not None])


def aggregate_for_question(df: DataFrame, q: dict, prof_rows, policy: str = "chart") -> DataFrame:
    """The answer to one question."""
    return answer_questions(df, [q], prof_rows, policy)


def dashboard(df: DataFrame, prof_rows, max_charts: int = 15) -> list[C.Chart]:
    """Q06: which charts the automatic dashboard shows, in the reference's order: metric histogram, box plot, metric by
    segment and by region, segment x region crosstab, a category distribution, a pie, correlations, a scatter, a bubble
    cloud, a sunburst over the dimensions, a segment -> region flow, then other metrics and categories up to 15."""
    k = kinds_of(prof_rows)
    rows = {r["column"]: r for r in prof_rows}
    nums, cats = k["num"], k["cat"]
    business = [c for c in nums if not _identifier_like(c, prof_rows)]
    candidates = business or nums
    if all(rows[c]["std"] is not None for c in candidates):  # P13 from the profile; numbers held as text are looked at
        main = max(candidates, key=lambda c: rows[c]["std"], default=None)
    else:
        main = Q.main_metric(df, candidates)
    dims = Q.dimensions(prof_rows)
    seg, reg, oth = dims["segment"], dims["region"], dims["other"]
    hierarchy = [d for d in (seg, reg, oth) if d][:3]
    out: list[C.Chart] = []
    if main:
        out += [C.Histogram(main), C.Box(main), *(means(d, main, prof_rows) for d in (seg, reg) if d)]
    if seg and reg:
        out.append(C.Cross(seg, reg))
    if cats:
        out.append(two_way(next((c for c in cats if rows[c]["nunique"] < 15), cats[0]), prof_rows, "bar"))
        out += [C.Shares(c, 8) for c in cats if 5 < rows[c]["nunique"] < 12][:1]
    if len(nums) >= 2:
        out.append(C.Correlations(business if len(business) >= 2 else nums))
    if len(business) >= 2:
        out.append(C.Trend(business[0], business[1], f"{business[0]}~{business[1]}"))
    if len(nums) >= 2:
        out.append(C.Bubble(nums[0], nums[1], nums[2] if len(nums) > 2 else None, cats[0] if cats else None))
    if len(cats) >= 2 and len(hierarchy) >= 2:
        out.append(C.Rollup(hierarchy, main))
    if seg and reg:
        out.append(C.Flow(seg, reg, main))
    more = [C.Histogram(c) for c in nums if c != main]
    more += [two_way(c, prof_rows, "bar") for c in cats if c not in (seg, reg, oth) and 3 < rows[c]["nunique"] < 20]
    return out + more[:max(0, max_charts - len(out))]


def auto_analyze(df: DataFrame, prof_rows, max_charts: int = 15) -> DataFrame:
    """Q06: the automatic dashboard on a (cleaned) table; charts are numbered from 1."""
    return C.draw(df, list(enumerate(dashboard(df, prof_rows, max_charts), 1)))


def identifier_like(df: DataFrame, col: str, prof_rows, order_cols=None) -> bool:
    """Name rule, or distinct ratio >= 0.995, or (with an explicit row
    order -- Spark has none) ratio >= 0.98 and monotonic in that order
    (W03, distributed), with at least 3 values."""
    if _identifier_like(col, prof_rows):
        return True
    r = next((r for r in prof_rows if r["column"] == col), None)
    if not order_cols or r is None or r["non_null"] < 3 or r["kind"] != "num":
        return False
    if r["nunique"] / r["non_null"] < 0.98:
        return False
    from ..operators.series import is_monotonic

    return bool(is_monotonic(df, col, list(order_cols)).first()["monotonic"])


def _identifier_like(col: str, prof_rows) -> bool:
    """P09 without an order column: name rule or distinct ratio >= 0.995."""
    low = col.lower()
    if low in ("id", "index", "uuid") or low.startswith("id_") or low.endswith("_id") or "identifiant" in low \
            or "num_acc" in low or low.startswith("num_"):
        return True
    r = next((r for r in prof_rows if r["column"] == col), None)
    if r is None or r["non_null"] < 3:
        return False
    return r["nunique"] / r["non_null"] >= 0.995


__all__ = ["aggregate_for_question", "answer_questions", "auto_analyze", "dashboard"]
