"""Checks and summaries of pages, runs and data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.functions.confidence import normalised
from palimpsest.functions.text import char_count, duration_text, error_type

#: Engines with least device, default, least and most batch, images a minute, most beams and a warning; fixed values.
ENGINES = (
    ("pylaia", "cpu", 32, 1, 128, 30.0, 1, None),
    ("trocr", "cpu", 24, 1, 64, 20.0, 10, None),
    ("churro", "cuda", 16, 1, 32, 15.0, 1, None),
    ("qwen3", "cuda", 4, 1, 8, 5.0, 1, "slow"),
    ("party", "cuda", 12, 1, 24, 12.0, 1, None),
    ("kraken", "cpu", 16, 1, 64, 18.0, 1, None),
    ("openwebui", "cpu", 1, 1, 1, 2.0, 1, "remote"),
    ("deepseek", "cuda", 4, 1, 8, 8.0, 1, None),
    ("lighton", "cuda", 16, 1, 32, 25.0, 1, None),
)
ENGINE_SCHEMA = "engine string, min_device string, default_batch int, min_batch int, max_batch int, images_per_min double, max_num_beams int, warning string"


def engine_registry(spark) -> DataFrame:
    return spark.createDataFrame(list(ENGINES), ENGINE_SCHEMA)


def with_engine(rows: DataFrame, registry: DataFrame, engine_col: str = "engine", default_per_minute: float = 10.0) -> DataFrame:
    """Adds the registry's columns; unknown engines get the default speed."""
    joined = rows.join(registry.withColumnRenamed("engine", engine_col), engine_col, "left")
    return joined.withColumn("images_per_min", F.coalesce("images_per_min", F.lit(default_per_minute)))


def config_errors(configs: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds error (first broken rule, null if none) and warnings to (engine, device, batch_size, num_beams, images)."""
    c = configs.join(registry, "engine", "left")
    error = (
        F.when(F.col("min_device").isNull(), "unknown engine")
        .when((F.col("min_device") == "cuda") & (F.col("device") == "cpu"), "needs a GPU")
        .when(~F.col("batch_size").between(F.col("min_batch"), F.col("max_batch")), "batch size out of range")
        .when(F.col("num_beams") > F.col("max_num_beams"), "too many beams")
    )
    slow = F.when((F.col("images") > 50) & (F.col("images_per_min") <= 5), "many images for a slow engine")
    return c.withColumn("error", error).withColumn("warnings", F.filter(F.array("warning", slow), lambda w: w.isNotNull())).select(*configs.columns, "error", "warnings")


def page_is_valid(has_page: Column, width: Column, height: Column, image_width: Column, image_height: Column, line_count: Column, slack: int = 10) -> Column:
    """A page element, a line, and sizes within slack pixels of the image's; missing sizes are not compared."""
    near = lambda a, b: F.coalesce(F.abs(a - b) <= slack, F.lit(True))
    sizes = F.when(width.isNotNull() & height.isNotNull(), near(width, image_width) & near(height, image_height)).otherwise(True)
    return F.coalesce(has_page & sizes & (line_count >= 1), F.lit(False))


def page_summary(lines: DataFrame, *by: str, text_col: str = "text", confidence_col: str = "confidence") -> DataFrame:
    """(by..., line_count, char_count, avg_confidence): null confidences do not count, without any the mean is null."""
    return lines.groupBy(*by).agg(F.count("*").alias("line_count"), F.sum(char_count(F.col(text_col))).alias("char_count"), F.avg(confidence_col).alias("avg_confidence"))


def batch_statistics(pages: DataFrame, seconds: float) -> DataFrame:
    """One row: pages, lines, chars, mean of the pages' mean confidences, speeds and the duration as text."""
    out = pages.agg(F.count("*").alias("pages"), F.sum("line_count").alias("lines"), F.sum("char_count").alias("chars"), F.avg("avg_confidence").alias("avg_confidence"))
    s = F.lit(float(seconds))
    return out.withColumns({"images_per_second": F.when(s > 0, F.col("pages") / s), "seconds_per_image": F.when(F.col("pages") > 0, s / F.col("pages")), "lines_per_second": F.when(s > 0, F.col("lines") / s), "duration": duration_text(s)})


def source_counters(pages: DataFrame, source_col: str = "line_source") -> DataFrame:
    """One row: how many pages used XML, failed to, and were segmented."""
    return pages.agg(*[F.count_if(F.col(source_col) == s).alias(s) for s in ("xml_used", "xml_failed", "auto_seg")])


def error_breakdown(failures: DataFrame, error_col: str = "error") -> DataFrame:
    """(error_type, n) by descending count."""
    return failures.groupBy(error_type(F.col(error_col)).alias("error_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def confidence_statistics(lines: DataFrame, *by: str, confidence_col: str = "confidence", low: float = 0.8) -> DataFrame:
    """(by..., n, avg, min, max, low): of the normalised confidences, and how many are below `low`."""
    c = lines.select(*by, normalised(F.col(confidence_col)).alias("c")).where("c is not null")
    return c.groupBy(*by).agg(F.count("*").alias("n"), F.avg("c").alias("avg"), F.min("c").alias("min"), F.max("c").alias("max"), F.count_if(F.col("c") < low).alias("low"))


def quality_bands(avg_height: Column, symbols: Column, lines: Column) -> Column:
    """struct of the guideline bands of a data set's mean line height, vocabulary size and number of lines."""
    height = F.when(avg_height < 40, "too small").when(avg_height < 50, "good").when(avg_height < 70, "very good").when(avg_height <= 90, "large").otherwise("too large")
    vocabulary = F.when(symbols < 50, "small").when(symbols < 100, "low").when(symbols <= 300, "typical").when(symbols <= 500, "high").otherwise("large")
    size = F.when(lines >= 10_000, "enough").when(lines >= 1_000, "few").otherwise("too few")
    return F.struct(height.alias("height"), vocabulary.alias("vocabulary"), size.alias("size"))


def tightening_statistics(lines: DataFrame, file_col: str = "file") -> DataFrame:
    """One row: files, mean of the files' mean heights before and after, reduction in percent."""
    files = lines.groupBy(file_col).agg(F.avg("height_before").alias("b"), F.avg("height_after").alias("a"))
    out = files.agg(F.count("*").alias("files"), F.avg("b").alias("before"), F.avg("a").alias("after"))
    return out.withColumn("reduction", F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before") * 100))


def token_usage(log: DataFrame) -> DataFrame:
    """Adds internal_tok (total less prompt and candidates) and internal_share of a run log."""
    internal = F.greatest(F.lit(0), F.col("total_tok") - F.col("prompt_tok") - F.col("cand_tok"))
    return log.withColumn("internal_tok", internal).withColumn("internal_share", F.when(F.col("total_tok") > 0, internal / F.col("total_tok")))


def orientation_counts(images: DataFrame, tag_col: str = "orientation") -> DataFrame:
    """(orientation, degrees, n) of the images whose EXIF tag asks for a turn."""
    turns = images.sparkSession.createDataFrame([(3, 180), (6, 270), (8, 90)], f"{tag_col} int, degrees int")
    return images.join(F.broadcast(turns), tag_col).groupBy(tag_col, "degrees").agg(F.count("*").alias("n"))


def settings_errors(configs: DataFrame) -> DataFrame:
    """Adds error, the first broken rule of a job's settings (null if none): input_exists, model_path, model_exists,
    model_id, adapter, adapter_exists, adapter_is_folder, api_key, formats (array), and the engine's needs: only_one (path or
    id, not both, and a vision model's id), remote (a key and an id)."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    weights = lambda c: F.endswith(lower(c), F.lit(".safetensors"))
    one = F.coalesce(F.col("only_one"), F.lit(False))
    remote = F.coalesce(F.col("remote"), F.lit(False))
    error = (
        F.when(~F.col("input_exists"), "input folder does not exist")
        .when(~given("model_path") & ~given("model_id"), "no model")
        .when(one & given("model_path") & given("model_id"), "model path and model id")
        .when(one & (F.contains(lower("model_path"), F.lit("adapter")) | weights("model_path")), "model path is an adapter")
        .when(one & F.contains(lower("model_id"), F.lit("qwen")) & ~F.contains(lower("model_id"), F.lit("-vl")), "model id is of a text model")
        .when(one & F.endswith(F.coalesce("adapter", F.lit("")), F.lit(".safetensors")), "adapter is a file")
        .when(remote & ~given("api_key"), "no key")
        .when(remote & ~given("model_id"), "no model id")
        .when(given("model_path") & ~F.col("model_exists"), "model file does not exist")
        .when(given("adapter") & ~F.col("adapter_exists"), "adapter does not exist")
        .when(given("adapter") & ~F.col("adapter_is_folder"), "adapter is a file")
        .when(F.size("formats") <= 0, "no output format")
    )
    return configs.withColumn("error", error)


def observed(lines: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The lines, and what is counted while they pass: lines, failures (where error is not null) and pages, about."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("failures"), F.approx_count_distinct("page").alias("pages")]
    return lines.observe(seen, *counts), seen


def success_counts(results: DataFrame, error_col: str = "error") -> DataFrame:
    """One row: how many succeeded and how many failed."""
    return results.agg(F.count_if(F.col(error_col).isNull()).alias("succeeded"), F.count_if(F.col(error_col).isNotNull()).alias("failed"))
