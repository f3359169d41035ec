"""Whole jobs: data sets from layout XML, page texts, batch transcription, evaluation, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import metrics
from palimpsest.operators import layout, pairing, quality, splits, vocabulary
from palimpsest.operators.transcribe import Transcriber, transcribe
from palimpsest.sources import layout_xml, lines, sinks


def line_dataset(spark: SparkSession, folder: str, images: DataFrame | None = None, kind: str = "page", least_width: int = 20, train_ratio: float = 0.8, recursive: bool = False) -> DataFrame:
    """Lines of a folder's PAGE or ALTO files with a split; with an image listing, only of pages that have an image."""
    pages = layout_xml.parse_pages(layout_xml.read_xml(spark, folder, recursive), kind)
    if images is not None:
        pairs = pairing.xml_with_images(pages.select("path"), images).select(F.col("xml_path").alias("path"), "image_path")
        pages = pages.join(pairs, "path")
    found = lines.alto_lines(pages, least_width) if kind == "alto" else lines.page_lines(pages, least_width)
    keyed = found.withColumn("id", F.concat_ws("_", "path", "line_id"))
    return splits.train_val_split(keyed, "id", train_ratio)


def dataset_summary(dataset: DataFrame) -> DataFrame:
    return splits.dataset_info(dataset, "path", F.col("width"), F.col("height"))


def lines_and_charset(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with their texts, blank ones included, and how often each character occurs."""
    found = lines.page_lines_with_blank_text(pages)
    return found, vocabulary.char_counts(found)


def polygons_and_vocabulary(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygon lines with their baseline angles, and the vocabulary by frequency."""
    from palimpsest.functions.geometry import baseline_angle

    found = lines.polygon_lines(pages).withColumn("angle", baseline_angle(F.col("baseline")))
    return found, vocabulary.frequency_vocabulary(found, "line_id")


def language_corpus(pages: DataFrame) -> DataFrame:
    """Token lines of all pages' texts."""
    return vocabulary.lm_corpus(lines.corpus_lines(pages), "text", "path", "line_idx")


def batch_transcription(work: DataFrame, transcriber: Transcriber, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, failures and page summaries of lines (page, line_id, line_idx, content) whose page is not done."""
    todo = pairing.pending(work, done, "page") if done is not None else work
    out = transcribe(todo, transcriber)
    good = out.where("error is null").drop("error")
    return good, out.where("error is not null"), quality.page_summary(good, "page")


def dry_run(work: DataFrame, transcriber: Transcriber, images_per_minute: float) -> DataFrame:
    """The first page's results with the minutes that all pages would take."""
    n = work.select("page").distinct().count()
    first = work.orderBy("page").select("page").limit(1)
    return transcribe(work.join(F.broadcast(first), "page", "left_semi"), transcriber).withColumn("eta_minutes", F.lit(n / images_per_minute if images_per_minute > 0 else None).cast("double"))


def evaluation(rows: DataFrame) -> DataFrame:
    """(id, reference, hypothesis, edits, cer as a share of the reference, at least one character)."""
    edits = metrics.edit_distance(F.col("reference"), F.col("hypothesis"))
    return rows.select("id", "reference", "hypothesis", edits.alias("edits"), (edits / F.greatest(F.lit(1), F.length("reference"))).alias("cer"))


def comparison(reference: DataFrame, hypothesis: DataFrame, page: str = "page", idx: str = "line") -> DataFrame:
    """Rates of lines paired by number, with an overall row, for one page."""
    pairs = pairing.by_ordinal(reference.withColumnRenamed("text", "reference"), hypothesis.withColumnRenamed("text", "hypothesis"), page, idx)
    r, h = F.col("reference"), F.col("hypothesis")
    rated = pairs.select(idx, r, h, metrics.cer(r, h).alias("cer"), metrics.wer(r, h).alias("wer"), metrics.match_percent(r, h).alias("match"), metrics.edit_distance(r, h).alias("distance"))
    return sinks.comparison_rows(rated, idx)


def segmentation_report(found: DataFrame, page: str = "page") -> DataFrame:
    """Quality figures of segmented lines by page and mode."""
    return layout.segmentation_quality(found, page, "mode")
