"""HTML table extraction over a pages DataFrame.

Re-aimed from "fetch one URL" to "a table of stored pages"
``(page_id, url, html)``.  Parsing HTML is the one step that needs Python on
the executors: ``parsed_pages`` runs the standard-library ``html.parser`` once
over each page (Arrow batches) and gives ONE NESTED ROW per page: its tables
(number, header, rows of cells) and an ``error`` if the markup could not be
read to its end (the tables up to there are kept, and the row says so).
Everything after that -- empty-row removal, table dimensions, best table per
page, stats -- is higher-order functions on that row: no shuffle, no second
parse.  A page without an id is a page like any other.

Parser rules: every ``<table>`` (nested ones too) is numbered in document
order and a cell belongs to the innermost open table; rows inside
``<thead>`` or made only of ``<th>`` cells before any data row are header
rows (the last one gives the column names, stripped); ``colspan`` repeats
the cell text; unclosed ``<td>``/``<tr>`` are closed by the next one;
entities are decoded.
"""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _TableParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []  # open tables: dict(no, rows, row, cell, in_head)
        self.count = 0
        self.done = []
        self.skip = 0  # inside <script>/<style>

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
            return
        if tag == "table":
            self.stack.append(dict(no=self.count, rows=[], row=None, cell=None, in_head=False, open={}, lent={}))
            self.count += 1
            return
        if not self.stack:
            return
        t = self.stack[-1]
        if tag == "thead":
            t["in_head"] = True
        elif tag in ("tbody", "tfoot"):
            self._close_row(t)
            t["in_head"] = False
        elif tag == "tr":
            self._close_row(t)
            t["row"] = dict(cells=[], head=t["in_head"])
        elif tag in ("td", "th"):
            self._close_cell(t)
            if t["row"] is None:
                t["row"] = dict(cells=[], head=t["in_head"])
            spans = {"colspan": 1, "rowspan": 1}
            for k, v in attrs:
                if k in spans and (v or "").strip().isdigit():
                    spans[k] = max(1, int(v))
            t["cell"] = dict(th=(tag == "th"), text=[], **spans)
        elif tag == "br" and t["cell"] is not None:
            t["cell"]["text"].append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            return
        if not self.stack:
            return
        t = self.stack[-1]
        if tag in ("td", "th"):
            self._close_cell(t)
        elif tag == "tr":
            self._close_row(t)
        elif tag == "thead":
            self._close_row(t)
            t["in_head"] = False
        elif tag == "table":
            self._close_row(t)
            self.done.append(self.stack.pop())

    def handle_data(self, data):
        if self.skip or not self.stack:
            return
        c = self.stack[-1]["cell"]
        if c is not None:
            c["text"].append(data)

    def _close_cell(self, t):
        c = t["cell"]
        if c is None:
            return
        text = " ".join("".join(c["text"]).split())
        self._lent(t)
        for _ in range(c["colspan"]):
            if c["rowspan"] > 1:
                t["lent"][len(t["row"]["cells"])] = (c["rowspan"], c["th"], text)
            t["row"]["cells"].append((c["th"], text))
        t["cell"] = None

    def _lent(self, t):
        """Cells of rows above that reach into this row at its next columns."""
        cells, lent = t["row"]["cells"], t["lent"]
        while len(cells) in t["open"]:
            left, th, text = t["open"].pop(len(cells))
            if left > 2:
                lent[len(cells)] = (left - 1, th, text)
            cells.append((th, text))

    def _close_row(self, t):
        self._close_cell(t)
        r = t["row"]
        if r is not None:
            self._lent(t)
            t["open"], t["lent"] = t["lent"], {}
        if r is not None and r["cells"]:
            t["rows"].append(r)
        t["row"] = None

    def tables(self):
        while self.stack:
            t = self.stack.pop()
            self._close_row(t)
            self.done.append(t)
        return sorted(self.done, key=lambda t: t["no"])


def parse_page(html: str | None) -> tuple[list[dict], str | None]:
    """The tables of a page, and what went wrong."""
    p, error = _TableParser(), None
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError, RecursionError) as e:  # what html.parser raises on markup it cannot read
        error = f"{type(e).__name__}: {e}"
    tables = []
    for t in p.tables():
        header, rows, first = [], [], 0
        for r in t["rows"]:
            cells = [text for _, text in r["cells"]]
            if not rows and (r["head"] or all(th for th, _ in r["cells"])):
                header += [None] * (len(cells) - len(header))
                header[:len(cells)] = cells  # the last header row names a column
                first += 1
            else:
                rows.append(cells)
        tables.append(dict(table_no=t["no"], first_row=first, header=header, rows=rows))
    return tables, error


TABLE_TYPE = "array<struct<table_no: int, first_row: int, header: array<string>, rows: array<array<string>>>>"
ARROW_TABLES = pa.list_(pa.struct([("table_no", pa.int32()), ("first_row", pa.int32()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))]))
MAX_CHARS_PER_BATCH = 16_000_000  # markup of one output batch


def _parsed(batches):
    schema = pa.schema([("page_id", pa.int64()), ("tables", ARROW_TABLES), ("error", pa.string())])
    for batch in batches:
        out, size = [], 0
        for pid, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tables, error = parse_page(html)
            out.append(dict(page_id=pid, tables=tables, error=error))
            size += len(html or "")
            if size >= MAX_CHARS_PER_BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _ship_parser() -> None:
    """Executors need this module's parser; pickle it by value so it travels
    with the task (no package install or --py-files needed on the workers)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parsed_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, tables, error), one row per page; ids may be NULL or repeat.

    Data rows whose cells are all empty are dropped, then tables without data rows."""
    _ship_parser()
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    raw = src.mapInArrow(_parsed, f"page_id long, tables {TABLE_TYPE}, error string")
    filled = lambda row: F.exists(row, lambda x: F.length(F.trim(x)) > 0)
    # rows keep their numbers within the table's markup
    numbered = lambda t: F.transform(t["rows"], lambda row, i: F.struct((t["first_row"] + i).alias("row_no"), row.alias("cells")))
    kept = F.transform("tables", lambda t: F.struct(t["table_no"].alias("table_no"), t["header"].alias("header"), F.filter(numbered(t), lambda r: filled(r["cells"])).alias("rows")))
    return raw.select("page_id", F.filter(kept, lambda t: F.size(t["rows"]) > 0).alias("tables"), "error")


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S11 in long form: (page_id, table_no, row_no, col_no, column_name, value) of the data cells of the kept tables.

    Header rows name the columns (stripped; unnamed columns get their position)."""
    t = parsed_pages(pages, id_col, html_col).select("page_id", F.explode("tables").alias("t"))
    r = t.select("page_id", "t.table_no", "t.header", F.explode("t.rows").alias("r"))
    c = r.select("page_id", "table_no", "header", "r.row_no", F.posexplode("r.cells").alias("col_no", "text"))
    name = F.coalesce(F.get("header", F.col("col_no")), F.col("col_no").cast("string"))
    return c.select("page_id", "table_no", "row_no", "col_no", name.alias("column_name"), F.when(F.length(F.trim("text")) > 0, F.col("text")).alias("value"))


def _stats(t: Column) -> Column:
    """S13 of one table."""
    rows = F.transform(t["rows"], lambda r: F.transform(r["cells"], lambda x: F.when(F.length(F.trim(x)) > 0, x)))
    n_rows = F.size(t["rows"])
    n_columns = F.array_max(F.transform(t["rows"], lambda r: F.size(r["cells"])))
    whole, number = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

    def dtype(i: Column) -> Column:
        held = F.filter(F.transform(rows, lambda r: F.get(r, i)), lambda x: x.isNotNull())
        return (F.when(F.size(held) == 0, F.lit("float64"))
                .when((F.size(held) == n_rows) & F.forall(held, lambda x: x.rlike(whole)), F.lit("int64"))
                .when(F.forall(held, lambda x: x.rlike(number)), F.lit("float64"))
                .otherwise(F.lit("object")))

    places = F.sequence(F.lit(0), n_columns - 1)
    missing = F.aggregate(rows, F.lit(0), lambda n, r: n + n_columns - F.size(F.filter(r, lambda x: x.isNotNull())))
    return F.struct(
        t["table_no"].alias("table_no"), n_rows.cast("long").alias("rows"), n_columns.cast("long").alias("columns"),
        F.round(100.0 * missing / F.greatest(n_rows * n_columns, F.lit(1)), 2).alias("missing_pct"),
        F.transform(places, lambda i: F.coalesce(F.get(t["header"], i), i.cast("string"))).alias("column_names"),
        F.transform(places, dtype).alias("dtypes"))


def page_stats(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, error, stats, best): per page the statistics of its tables (rows, columns, % missing cells, column names and a
    pandas-style dtype per column: ``int64`` for integers without gaps, ``float64`` for other numbers or nothing, else
    ``object``) and S12, the table with the most cells (the first one on ties)."""
    stats = parsed_pages(pages, id_col, html_col).select("page_id", "error", F.transform("tables", _stats).alias("stats"))
    ranked = F.transform("stats", lambda t: F.struct((-t["rows"] * t["columns"]).alias("cells"), t["table_no"].alias("no"), t.alias("t")))
    return stats.select("*", F.array_min(ranked)["t"].alias("best"))


def table_stats(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per kept table."""
    return page_stats(pages, id_col, html_col).select("page_id", F.explode("stats").alias("t")).select("page_id", "t.*")


def best_table(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page that has a table."""
    return page_stats(pages, id_col, html_col).filter("best IS NOT NULL").select("page_id", "best.*")
