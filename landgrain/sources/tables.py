"""Sources and sinks: text tables cast column by column, packed rows, GeoJSON, monthly series, tiles and stages."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landgrain.functions.exprs import finite_all


def read_text_table(spark: SparkSession, path: str, schema: dict[str, str], strict: tuple[str, ...] = (), **options) -> DataFrame:
    """A delimited text table, all strings first; ``strict`` columns must cast, all others become NULL if they don't."""
    raw = spark.read.options(header=True, **options).csv(path)
    cast = lambda c, kind: F.col(c).cast(kind) if c in strict else F.col(c).try_cast(kind)
    return raw.select(*(cast(c, kind).alias(c) for c, kind in schema.items()))


def read_headless(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep)


def read_box(spark: SparkSession, path: str, columns: list[str], west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose nested box overlaps the window; the filters reach the Parquet row groups."""
    box = (
        (F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south)
    )
    return spark.read.parquet(path).where(box).select(*columns)


def read_geojson(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """One row per readable feature: its properties as strings and its rings, for polygons and multipolygons."""
    props = ", ".join(f"`{p}`: string" for p in properties)
    feature = f"struct<geometry: struct<type: string, coordinates: string>, properties: struct<{props}>>"
    whole = spark.read.text(path, wholetext=True)
    features = whole.select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    ring = "array<array<double>>"
    rings = F.when(
        F.col("f.geometry.type") == "Polygon", F.from_json("f.geometry.coordinates", f"array<{ring}>")
    ).when(
        F.col("f.geometry.type") == "MultiPolygon",
        F.flatten(F.from_json("f.geometry.coordinates", f"array<array<{ring}>>")),
    )
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    out = features.select(*(F.col(f"f.properties.{p}").alias(p) for p in properties), points.alias("rings"))
    return out.where(F.col("rings").isNotNull())


def unpack_rows(df: DataFrame, packed: str, row_sep: str, field_sep: str, schema: dict[str, str]) -> DataFrame:
    """One packed text per row into many rows of typed fields; an empty field is NULL."""
    keep = [c for c in df.columns if c != packed]
    rows = df.select(*keep, F.explode(F.split(packed, row_sep, -1)).alias("_row")).where("_row <> ''")
    fields = F.split("_row", field_sep, -1)
    return rows.select(
        *keep, *(F.nullif(F.get(fields, F.lit(i)), F.lit("")).try_cast(k).alias(c) for i, (c, k) in enumerate(schema.items()))
    )


def pack_rows(df: DataFrame, key: str, columns: list[str], row_sep: str = ";", field_sep: str = ",") -> DataFrame:
    """The inverse: (key, packed), NULLs as empty fields, rows in the order of their text."""
    fields = F.concat_ws(field_sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(fields)), row_sep).alias("packed"))


def monthly_series(df: DataFrame, date: str | Column, value: str) -> DataFrame:
    """(month, value): the mean by the month that a date or a text starts with."""
    month = F.substring(F.col(date).cast("string") if isinstance(date, str) else date.cast("string"), 1, 7)
    return df.groupBy(month.alias("month")).agg(F.avg(value).alias("value"))


def read_parts(spark: SparkSession, paths: list[str], schema: str, **options) -> DataFrame:
    """A table that came in parts: all files by one scan, columns by name."""
    return spark.read.schema(schema).options(header=True, **options).csv(paths)


def write_csv(df: DataFrame, path: str) -> None:
    """A delimited table with names in the first line of each file; text is quoted where it must be."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Nested documents, one a line; NaN and infinities as null."""
    finite_all(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tiled(df: DataFrame, path: str, x: str, y: str, size: float) -> DataFrame:
    """Rows in one folder per tile; returns the tile index (ti, tj, rows)."""
    tiled = df.withColumn("ti", F.floor(F.col(x) / size)).withColumn("tj", F.floor(F.col(y) / size))
    tiled.repartition("ti", "tj").write.mode("overwrite").partitionBy("ti", "tj").parquet(path)
    # Counted from what was written; tiles are folders, so no column is read.
    return df.sparkSession.read.schema(tiled.schema).parquet(path).groupBy("ti", "tj").agg(F.count("*").alias("rows"))


def stage(df: DataFrame, path: str) -> DataFrame:
    """A stage table: written once, read by what follows and by later runs."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A digest of the plan of ``df`` and of the names, sizes and times of the files that it reads."""
    plan = re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    files = sorted(df.inputFiles())
    if files:
        rows = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
        files = [tuple(map(str, r)) for r in rows.orderBy("path").collect()]  # a row per file, no content
    return hashlib.sha256(repr((plan, df.schema.json(), files)).encode()).hexdigest()


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: the commit's marker is the last file that a write leaves."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stage_once(df: DataFrame, root: str, name: str) -> DataFrame:
    """A stage table that a later run of the same plan over the same files reads instead of making it again.

    Its folder carries the fingerprint; one without the commit's marker was left half-written and is made anew. Plans
    must be deterministic; two runs at the same time may both write, and the last one stays.
    """
    spark, path = df.sparkSession, f"{root}/{name}-{fingerprint(df)}"
    if not finished(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_optional(base: DataFrame, extra: DataFrame | None, keys: list[str]) -> DataFrame:
    """``base`` and those rows of an optional second source whose keys it lacks."""
    return base if extra is None else base.unionByName(extra.join(base.select(*keys).distinct(), keys, "left_anti"))


def clustered(df: DataFrame, *keys: str, files: int = 8) -> DataFrame:
    """Sorted by range for scans that prune by the keys."""
    return df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
