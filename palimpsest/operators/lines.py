"""Lines of texts and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import has_text


def text_lines(docs: DataFrame, id_col: str, text_col: str = "text", keep_blank: bool = False) -> DataFrame:
    """(id, line_idx from 0, text) for each line; line numbers count blank lines even where those are left out."""
    text = F.when(F.contains(F.col(text_col), F.lit("\r")), F.regexp_replace(text_col, "\r\n?", "\n")).otherwise(F.col(text_col))
    lines = docs.select(id_col, F.posexplode(F.split(text, "\n")).alias("line_idx", "text"))
    return lines if keep_blank else lines.where(has_text(F.col("text")))


def page_text(lines: DataFrame, page_col: str, order_col: str, text_col: str = "text", end: str = "") -> DataFrame:
    """(page, text): a page's lines in order, joined by line feeds; null texts are empty lines. A page is bounded."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order_col), F.coalesce(text_col, F.lit("")).alias("t"))))
    return lines.groupBy(page_col).agg(F.concat(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), F.lit(end)).alias("text"))


def number_lines(lines: DataFrame, page_col: str, *order: str) -> DataFrame:
    """Adds line_number from 1 in the given order within each page."""
    from pyspark.sql import Window

    return lines.withColumn("line_number", F.row_number().over(Window.partitionBy(page_col).orderBy(*order)))
