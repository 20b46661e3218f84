"""Scans of yearly tables, raw logs, delimited text and saved vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.bins import log_bin
from tidemark.functions.text import concat_timestamp, split_fields
from tidemark.spec import RAW_COLUMNS


def scan_years(
    spark: SparkSession, root: str, years: Sequence[int], part: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Rows of the listed years (and part) of a table laid out as ``year=/part=``."""
    if not years:
        raise ValueError("no years given")
    reader = spark.read.schema(schema) if schema else spark.read
    table = reader.parquet(root).filter(F.col("year").isin(*years))
    return table.filter(F.col("part") == part) if part else table


def scan_year_files(
    spark: SparkSession, root: str, years: Sequence[int], size: str, held_out: bool, schema: T.StructType
) -> DataFrame:
    """The file-per-year layout ``<size>/<year>_<size>[_valid].parquet``; ``year`` from the name."""
    suffix = "_valid" if held_out else ""
    paths = [f"{root}/{size}/{y}_{size}{suffix}.parquet" for y in years]
    rows = spark.read.schema(schema).parquet(*paths)
    year = F.regexp_extract("_metadata.file_path", rf"/(\d{{4}})_{size}", 1).cast("int")
    return rows.withColumn("year", year).withColumn("part", F.lit("valid" if held_out else "train"))


def scan_raw_log(spark: SparkSession, root: str) -> DataFrame:
    """Tab-separated lines under ``<root>/<year>/<month>/``: 20 text columns, year and month.

    Folders may also be written ``name=value``. Fields 0..17 are kept; column 18 is ``year_month_<second-last field>`` and column 19
    the last field.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    path = F.col("_metadata.file_path")
    folders = r"/(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)/[^/]+$"
    all_fields, first = F.split("value", "\t"), split_fields(F.col("value"))
    parsed = lines.select(
        first.alias("f"),
        F.element_at(all_fields, -2).alias("clock"),
        F.element_at(all_fields, -1).alias("proto"),
        F.regexp_extract(path, folders, 1).alias("year"),
        F.regexp_extract(path, folders, 2).alias("month"),
    )
    return parsed.select(
        *[F.get("f", F.lit(i)).alias(RAW_COLUMNS[i]) for i in range(18)],
        concat_timestamp(F.col("year"), F.col("month"), F.col("clock")).alias("18"),
        F.col("proto").alias("19"),
        F.col("year").cast("int").alias("year"),
        F.col("month").cast("int").alias("month"),
    )


def bin_raw_columns(df: DataFrame, columns: Sequence[str] = ("0", "2", "3")) -> DataFrame:
    """Replace raw numeric text by its log-bin label."""
    return df.select(
        *[log_bin(F.col(f"`{c}`").cast("double"), c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    )


BAD_RECORD = "_bad_record"


def scan_delimited(
    spark: SparkSession, path: str, schema: T.StructType, whitespace: bool = False, header: bool = False, lenient: bool = False
) -> DataFrame:
    """Comma CSV, or fields separated by any run of blanks.

    A line that does not fit the schema - a field too few or too many, or text that is no number -
    fails the scan. With ``lenient`` it becomes a row of NULLs, and the column ``_bad_record`` holds the line.
    """
    if not whitespace:
        reader = spark.read.option("header", str(header).lower())
        if not lenient:
            return reader.schema(schema).option("mode", "FAILFAST").csv(path)
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
        rows = reader.schema(T.StructType([*schema, T.StructField(BAD_RECORD, T.StringType())])).csv(path)
        good = F.col(BAD_RECORD).isNull()
        return rows.select(*[F.when(good, F.col(f.name)).alias(f.name) for f in schema], BAD_RECORD)
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    values = [F.get(fields, F.lit(i)).try_cast(f.dataType) for i, f in enumerate(schema)]
    fits = F.size(fields) == len(values)
    for i, value in enumerate(values):
        fits = fits & (value.isNotNull() | F.get(fields, F.lit(i)).isNull())
    if lenient:
        cells = [F.when(fits, v).alias(f.name) for v, f in zip(values, schema)]
        return lines.select(*cells, F.when(~fits, F.col("value")).alias(BAD_RECORD))
    checked = lines.withColumn("value", F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "value"))))
    return checked.select(*[v.alias(f.name) for v, f in zip(values, schema)])


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a saved tokenizer file: the map at ``model.vocab``."""
    text = spark.read.option("wholetext", "true").text(path)
    vocab = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,int>")
    return text.select(F.explode(vocab).alias("token", "id"))
