"""Results out: JSON, CSV, and HTML reports."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in one folder per value of ``by`` if given."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; the columns stand sorted, arrays joined by commas."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array<string") else F.col(c) for c, t in sorted(rows.dtypes)]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def index_rows(segments: DataFrame) -> DataFrame:
    """Index rows to report: without separators and cover sheets."""
    return segments.where(~F.col("doc_type").isin("Cover Sheet", "Separator") | F.col("doc_type").isNull())


def html_table(rows: DataFrame, title: str, extra: str = "") -> str:
    """A report for reading, every row of it; nulls show as "-".  Rows come to
    the driver a partition at a time; ``write_html`` is for reports that don't
    fit there."""
    head, body = _head(rows.columns), "".join(map(_row, rows.toLocalIterator()))
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><table>\n{head}{body}</table>{extra}\n"


def _head(columns: list[str]) -> str:
    return "<tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + "</tr>\n"


def _row(values: tuple) -> str:
    return "<tr>" + "".join(f"<td>{'-' if v is None else escape(str(v))}</td>" for v in values) + "</tr>\n"


def write_html(rows: DataFrame, path: str) -> None:
    """A report of any length as HTML tables, one a file, written by the executors."""
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("-")), F.lit("</td>"))
    rows.select(F.concat(F.lit("<tr>"), *map(cell, rows.columns), F.lit("</tr>"))).write.mode("overwrite").text(path)


def review_page(rows: DataFrame, images: list[str], title: str = "Review") -> str:
    """A summary's rows and a gallery of page images."""
    return html_table(rows, title, "".join(f'<figure><img src="{escape(i)}"><figcaption>{escape(i)}</figcaption></figure>' for i in images))


def split_manifest(parts: DataFrame, base: str) -> DataFrame:
    """(bundle, pdf, start, end, type): one file a part, named by its number."""
    name = F.concat(F.lit(base), F.lit("_part_"), F.lpad(F.col("part").cast("string"), 3, "0"), F.lit(".pdf"))
    return parts.select("bundle", name.alias("pdf"), F.col("start_page").alias("start"), F.col("end_page").alias("end"), "type")


def index_report(segments: DataFrame, totals: DataFrame) -> str:
    """An index for a terminal: totals, then each provider's documents by date."""
    out = [f"{t['bundle']}: {t['total_pages']} pages, {t['provider_count']} providers, {t['encounter_count']} documents" for t in totals.orderBy("bundle").toLocalIterator()]
    shown = index_rows(segments).orderBy("bundle", "provider", "dos", "start_page").toLocalIterator()
    return "\n".join([*out, *(f"{s['provider']}  {s['dos'] or '-'}  {s['doc_type']}  pages {s['start_page']}-{s['end_page']}" for s in shown)])
