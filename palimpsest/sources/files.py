"""File listings, line lists and small table formats as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.pairing import path_parts

IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")
WEIGHTS = ("model.safetensors", "pytorch_model.bin", "best_model.pt")


def image_files(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] = IMAGES, any_case: bool = False, content: bool = False) -> DataFrame:
    """Distinct image files (path, length, modificationTime) by extension, in lower or upper case, or in any mixture."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext = path_parts(F.col("path"))["ext"]
    good = F.lower(ext).isin(*extensions) if any_case else ext.isin(*extensions, *[e.upper() for e in extensions])
    columns = ["path", "length", "modificationTime", *["content"] * content]
    return files.where(good).select(*columns).dropDuplicates(["path"])


def model_folders(spark: SparkSession, path: str, weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """Folders that hold a weight file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(path_parts(F.col("path")).alias("p"))
    return files.where(F.col("p.name").isin(*weights)).select(F.col("p.dir").alias("folder")).distinct().orderBy("folder")


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (image_path, text); texts such as NA and nan stay texts."""
    return spark.read.schema("image_path string, text string").option("multiLine", "true").option("escape", '"').csv(path)


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, text, malformed) from 'path.png text' lines, cut at the first '.png '; other lines are malformed
    and hold the line as an id."""
    line = F.col("value")
    at = F.locate(".png ", line)
    image = F.when(at > 0, F.substring(line, F.lit(1), at + 3)).otherwise(line)
    return spark.read.text(path).where("value <> ''").select(image.alias("image_path"), F.when(at > 0, F.substring(line, at + 5, F.length(line))).alias("text"), (at == 0).alias("malformed"))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_idx, text): the lines of text files with carriage returns removed, blank ones included."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    lines = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
    lines = F.when(F.endswith("value", F.lit("\n")), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return files.select("path", F.posexplode(lines).alias("line_idx", "text"))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Arrow IPC files or streams of one schema, from any store that Spark reads, each file whole in one row; the
    schema is that of the first file. A folder without such files raises an error. read_arrow_blocks takes files of any
    size, from stores that pyarrow reads."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{arrow,ipc,feather}").load(path).select("content")

    def opened(content: bytes):
        try:
            return pa.ipc.open_file(pa.BufferReader(content))
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(pa.BufferReader(content))

    def schemas(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([opened(c.as_py()).schema.serialize().to_pybytes() for c in batch.column(0)], pa.binary())], ["schema"])

    first = files.where("length(content) > 0").limit(1).mapInArrow(schemas, "schema binary").first()
    if first is None:
        raise ValueError(f"no Arrow files under {path}")
    schema = pa.ipc.read_schema(pa.BufferReader(bytes(first[0])))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from opened(content.as_py()).read_all().cast(schema).to_batches()

    return files.where("length(content) > 0").mapInArrow(run, from_arrow_schema(schema))


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings of a YAML or JSON file, read on the driver through Spark's reader; YAML needs the yaml package."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Settings as JSON, which is YAML too, in a folder of one text file."""
    spark.createDataFrame([(json.dumps(settings, indent=2, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
