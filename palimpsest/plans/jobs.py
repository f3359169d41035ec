"""Whole jobs from files to files: trainers' data sets, page inference, batch transcription, segmentation, Arrow splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.geometry import baseline_angle
from palimpsest.functions.text import strip
from palimpsest.operators import images as pixels
from palimpsest.operators import language_model, layout, pairing, quality, splits, vocabulary
from palimpsest.operators.numbering import numbered
from palimpsest.operators.transcribe import Segmenter, Transcriber, segment_pages, transcribe
from palimpsest.sources import files, layout_xml, lines, sinks
from palimpsest.sources.arrow_files import read_arrow_blocks

#: Least height of a line for convolutional engines; fixed value.
LEAST_HEIGHT = 40


def csv_samples(pairs: DataFrame, images: DataFrame, data_root: str, target_height: int | None = 64) -> DataFrame:
    """(number, text, png, error) from a list of (number, image_path, text) and images (page, height, width, pixels) whose
    page ends with data_root/image_path: errors are a missing image and an empty text. Texts are stripped."""
    name = F.concat(F.lit(data_root.rstrip("/") + "/"), F.col("image_path"))
    ending = lambda c: F.regexp_replace(c, "^file:/*", "/")  # noqa: E731  local paths with and without a scheme
    joined = pairs.withColumn("_at", ending(name)).join(images.withColumn("_at", ending(F.col("page"))).select("_at", "height", "width", "pixels"), "_at", "left")
    text = strip(F.coalesce("text", F.lit("")))
    error = F.when(F.col("pixels").isNull(), F.concat(F.lit("Image not found: "), name)).when(text == "", "Empty text")
    return pixels.png_files(joined.select("number", text.alias("text"), error.alias("error"), "height", "width", "pixels"), target_height).select("number", "text", F.when(F.col("error").isNull(), F.col("png")).alias("png"), "error")


def csv_to_trainer(spark: SparkSession, csv: str, images: DataFrame, data_root: str, out: str, target_height: int = 64) -> DataFrame:
    """Turns a headerless CSV of image paths and texts into a trainer's folder (see write_trainer_set). Rows are numbered as
    they come, rows of the file that fail included."""
    rows = files.read_pairs_csv(spark, csv).withColumn("_order", F.monotonically_increasing_id())
    samples = csv_samples(numbered(rows, "_order"), images, data_root, target_height)
    return sinks.write_trainer_set(samples, out, csv=csv, data_root=data_root, target_height=target_height)


def page_inference(pages: DataFrame | None, images: DataFrame, transcriber: Transcriber, segmenter: Segmenter | None = None, pad: int = 5) -> DataFrame:
    """(page, text): each page's lines transcribed in order, blank ones left out, joined by line feeds. Lines come from parsed
    pages (path, ...; path as the images' page), or from a segmenter where pages is None; pages without lines give no row."""
    if pages is not None:
        found = lines.guided_lines(pages, pad).select(F.col("path").alias("page"), "line_id", F.col("position").alias("line_idx"), "padded.*", "coords", F.lit(0.0).alias("angle"))
    else:
        box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
        found = segment_pages(images, segmenter).where("error is null").select("page", "line_id", "line_idx", *box, F.lit(None).cast("array<struct<x:int,y:int>>").alias("coords"), F.lit(0.0).alias("angle"))
    crops = pixels.png_files(pixels.line_images(found, images, pad=0))
    work = crops.join(found.select("page", "line_id", "line_idx"), ["page", "line_id"]).select("page", "line_id", "line_idx", F.col("png").alias("content"))
    return page_text_of(transcribe(work, transcriber))


def page_text_of(results: DataFrame) -> DataFrame:
    """(page, text) of transcribed lines, blank and failed ones left out."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct("line_idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"] != "")
    return results.groupBy("page").agg(F.array_join(F.transform(kept, lambda x: x["t"]), "\n").alias("text"))


def batch_lines(images: DataFrame, pages: DataFrame, segmented: DataFrame, least_height: int = LEAST_HEIGHT, pad: int = 5) -> tuple[DataFrame, DataFrame]:
    """Lines (page, line_id, line_idx, x1, y1, x2, y2, line_source) of images (path, height, width) and one row per image
    (page, line_source): from its layout file where there is a valid one (see images_with_xml, page_is_valid), else from the
    segmenter's lines (page, line_id, line_idx, x1, y1, x2, y2). line_source is xml_used, xml_failed or auto_seg. Lines lower
    than least_height are left out."""
    pairs = pairing.images_with_xml(images, pages)
    about = pages.select(F.col("path").alias("xml_path"), (F.col("error").isNull()).alias("has_page"), F.col("width").alias("w"), F.col("height").alias("h"), F.size("lines").alias("n"))
    joined = images.select(F.col("path").alias("image_path"), "width", "height").join(pairs, "image_path").join(about, "xml_path", "left")
    valid = quality.page_is_valid(F.col("has_page"), F.col("w"), F.col("h"), F.col("width"), F.col("height"), F.col("n"))
    source = F.when(F.col("xml_path").isNull(), "auto_seg").when(valid, "xml_used").otherwise("xml_failed")
    sources = joined.select(F.col("image_path").alias("page"), "xml_path", source.alias("line_source"))
    guided = lines.guided_lines(pages, pad).select(F.col("path").alias("xml_path"), "line_id", F.col("position").alias("line_idx"), "padded.*")
    columns = ["page", "line_id", "line_idx", "x1", "y1", "x2", "y2", "line_source"]
    own = guided.join(sources.where("line_source = 'xml_used'"), "xml_path").select(columns)
    other = segmented.join(sources.where("line_source <> 'xml_used'"), "page").select(columns)
    return layout.tall_enough(own.unionByName(other), least_height), sources.select("page", "line_source")


def run_batch(work: DataFrame, transcriber: Transcriber, out: str, done: DataFrame | None = None, pages_per_file: int | None = None, **about: object) -> DataFrame:
    """Transcribes lines (page, line_id, line_idx, content) of pages that are not done and writes texts (see write_pages),
    page summaries and failures under a folder; returns one row with both counts. A page of which some line failed is in
    both."""
    todo = pairing.pending(work, done, "page") if done is not None else work
    results = transcribe(todo, transcriber)
    sinks.write_lines_parquet(results, f"{out}/lines")
    results = work.sparkSession.read.parquet(f"{out}/lines")
    good = results.where("error is null")
    sinks.write_pages(page_text_of(good), f"{out}/transcriptions", "page", "text", pages_per_file)
    sinks.write_summary(quality.page_summary(good, "page"), results.where("error is not null"), out, **about)
    return quality.success_counts(results)


def segmentation_batch(found: DataFrame, out: str, page: str = "page", pages_per_file: int | None = None) -> DataFrame:
    """Writes page documents (see write_pages) and quality figures of segmented lines (see page_xml) under a folder; returns one row of totals."""
    sinks.write_pages(sinks.page_xml(found, page, sinks.PAGE_2019, with_text=False), f"{out}/page_xml", page, "xml", pages_per_file)
    figures = layout.segmentation_quality(found, page, "mode")
    figures.write.mode("overwrite").option("header", "true").csv(f"{out}/qc")
    return figures.agg(F.count("*").alias("pages"), F.avg("lines").alias("avg_lines"), F.count_if(F.col("mode") != "neural").alias("fallbacks"))


def page_to_parquet(spark: SparkSession, folder: str, images: DataFrame, out: str, most_pages: int | None = None) -> tuple[int, DataFrame]:
    """Lines of a folder's pages that have an image, as Parquet, and the counts of their characters; most_pages limits the
    files that are read, by name. Returns the number of lines and the counts."""
    xml = layout_xml.read_xml(spark, folder)
    if most_pages:
        xml = splits.first_pages(xml, most_pages)
    pages = layout_xml.parse_pages(xml)
    pairs = pairing.xml_with_images(pages.select("path"), images).select(F.col("xml_path").alias("path"), "image_path")
    sinks.write_lines_parquet(lines.page_lines_with_blank_text(pages.join(pairs, "path")), f"{out}/lines")
    found = spark.read.parquet(f"{out}/lines")
    counts = vocabulary.char_counts(found)
    sinks.symbol_rows(vocabulary.sorted_charset(found)).write.mode("overwrite").text(f"{out}/charset")
    return found.count(), counts


def polygon_set(pages: DataFrame, images: DataFrame, page_images: DataFrame, out: str, target_height: int = 64) -> DataFrame:
    """A trainer's folder of polygon lines: pages (see parse_pages) with the image of images_with_xml, lines cut out along
    their polygon, turned upright by their baseline and resized. page_images are (page, height, width, pixels), page being
    the image's path. Lines without text, and those whose crop is empty, are in the log."""
    pairs = pairing.xml_with_images(pages.select("path"), images).select(F.col("xml_path").alias("path"), "image_path")
    found = numbered(lines.polygon_lines(pages).join(pairs, "path"), "path", "region_idx", "line_idx")
    cut = found.select(F.col("image_path").alias("page"), F.col("number").cast("string").alias("line_id"), "x1", "y1", "x2", "y2", "coords", baseline_angle(F.col("baseline")).alias("angle"))
    crops = pixels.png_files(pixels.line_images(cut, page_images, target_height, mask=True, deskew=True)).select(F.col("line_id").cast("bigint").alias("number"), "png")
    text = strip(F.coalesce("text", F.lit("")))
    error = F.when(F.col("png").isNull(), "Empty crop").when(text == "", "Empty text")
    samples = found.join(crops, "number", "left").select("number", text.alias("text"), F.when(error.isNull(), F.col("png")).alias("png"), error.alias("error"))
    return sinks.write_trainer_set(samples, out, target_height=target_height)


def arrow_split(spark: SparkSession, path: str, out: str, key: Column, train_ratio: float = 0.8) -> dict[str, int]:
    """Splits Arrow files into train and val folders of Arrow streams, with a list of each beside them; the key, of which
    equal rows stay together, puts rows in order by its hash. Returns how many rows went where."""
    rows = splits.train_val_split(read_arrow_blocks(spark, path).withColumn("_key", key), "_key", train_ratio).drop("_key")
    counts = {r.split: r.n for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}
    for name in ("train", "val"):
        sinks.write_arrow(rows.where(F.col("split") == name).drop("split"), f"{out}/{name}")
        spark.createDataFrame([(f"{name}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}.lst")
    return {name: counts.get(name, 0) for name in ("train", "val")}


def language_model_counts(spark: SparkSession, path: str, kind: str = "page", orders: tuple[int, ...] = (1, 2, 3, 4, 5)) -> tuple[DataFrame, DataFrame]:
    """Token lines for a character model and the counts of their n-grams, from a folder of layout files (page, alto or auto)
    or, with kind text, of text files."""
    if kind == "text":
        found = files.read_text_lines(spark, path).withColumn("text", strip(F.col("text"))).where("text <> ''")
    else:
        found = lines.corpus_lines(layout_xml.parse_pages(layout_xml.read_xml(spark, path), kind))
    return vocabulary.lm_corpus(found, "text", "path", "line_idx"), vocabulary.ngram_counts(found, "text", orders)


def character_model(spark: SparkSession, path: str, out: str, kind: str = "page", order: int = 5) -> DataFrame:
    """Trains a character model on a folder of layout files or texts (see language_model_counts) and writes it: out/arpa, text
    files that one after the other are the model in the ARPA format, and out/model, the table (n, gram, logp, backoff), which
    is returned."""
    if kind == "text":
        found = files.read_text_lines(spark, path)
    else:
        found = lines.corpus_lines(layout_xml.parse_pages(layout_xml.read_xml(spark, path), kind))
    model = language_model.kneser_ney(language_model.adjusted_counts(found, order), order)
    model.write.mode("overwrite").parquet(f"{out}/model")
    model = spark.read.parquet(f"{out}/model")
    sinks.arpa_rows(model).write.mode("overwrite").text(f"{out}/arpa")
    return model


def write_evaluation(rows: DataFrame, path: str) -> DataFrame:
    """Writes (id, reference, hypothesis, cer) of evaluated lines as CSV and returns one row: samples, mean and micro rate."""
    from palimpsest.plans.pipelines import evaluation

    rated = evaluation(rows)
    rated.select("id", "reference", "hypothesis", F.round("cer", 4).alias("cer")).orderBy("id").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    return rated.agg(F.count("*").alias("samples"), F.avg("cer").alias("cer"), (F.sum("edits") / F.greatest(F.lit(1), F.sum(F.length("reference")))).alias("micro_cer"))


def preview(rows: DataFrame, *order: str, most: int = 10) -> DataFrame:
    """The first rows by an order, for a look at them."""
    return rows.orderBy(*order).limit(most)
