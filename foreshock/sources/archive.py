"""Inventory of a day-file archive and metadata held in file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Archive path layout and label file name patterns.
ARCHIVE_PATTERN = (
    r"(\d{4})/([^/]+)/([^/]+)/([^./]+)\.([^./]+)/"
    r"([^./]*)\.([^./]*)\.([^./]*)\.([^./]*)\.([^./]+)\.(\d{4})\.(\d{3})$"
)
LABEL_PATTERN = (
    r"^label_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})_step-(\d+)-(minutes|hours)_dtf-(\d+)(?:_ie-([01]))?(?:\.csv)?$"
)


def parse_archive_paths(paths: DataFrame) -> DataFrame:
    """``(path, series, day)``; paths of another layout are dropped."""

    def part(i: int):
        return F.regexp_extract("path", ARCHIVE_PATTERN, i)

    return paths.where(F.col("path").rlike(ARCHIVE_PATTERN)).select(
        "path",
        F.upper(F.concat_ws(".", part(6), part(7), part(8), part(9))).alias("series"),
        F.date_add(F.make_date(part(11).cast("int"), F.lit(1), F.lit(1)), part(12).cast("int") - 1).alias("day"),
    )


def archive_inventory(paths: DataFrame, start: str, end: str) -> DataFrame:
    """Every series-day of the range with ``status`` 'present' or 'missing'."""
    found = parse_archive_paths(paths).select("series", "day").distinct()
    calendar = found.select("series").distinct().select(
        "series", F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day")
    )
    marked = found.withColumn("present", F.lit(True))
    return calendar.join(marked, ["series", "day"], "left").select(
        "series", "day", F.when(F.col("present"), "present").otherwise("missing").alias("status")
    )


def parse_label_name(names: DataFrame, column: str = "name") -> DataFrame:
    """Typed metadata of label file names; the older five-part form means ie = 0.

    A name of any other form is an error.
    """

    def part(i: int):
        return F.regexp_extract(column, LABEL_PATTERN, i)

    ok = F.when(
        F.col(column).rlike(LABEL_PATTERN), F.lit(True)
    ).otherwise(F.raise_error(F.concat(F.lit("not a label file name: "), F.col(column))).cast("boolean"))
    return names.where(ok).select(
        column,
        F.to_date(part(1)).alias("start_date"),
        F.to_date(part(2)).alias("end_date"),
        part(3).cast("int").alias("window_step"),
        part(4).alias("window_step_unit"),
        part(5).cast("int").alias("day_to_forecast"),
        F.when(part(6) == "1", 1).otherwise(0).alias("include_event_date"),
    )


def load_labels(spark, path: str) -> DataFrame:
    """Label CSV files of a folder with the metadata of their names."""
    df = spark.read.schema("ts timestamp, id long, is_erupted int").option("header", True).csv(path)
    df = df.withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    meta = parse_label_name(df.select("name").distinct())
    return df.join(meta, "name")
