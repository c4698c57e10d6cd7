"""Sources and sinks: feature collections, point tables, places, zone folders; CSV and line-delimited features out."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cityloom.functions import geometry as geo, text as tx
from cityloom.sources.collections import read_features

RING = "array<struct<x:double,y:double>>"


def work_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir; an own one only where that is unset and Spark runs locally."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def growing(df: DataFrame) -> DataFrame:
    """df, which Spark joins without sending it to all tasks on account of its size as a file.

    A table of keys and classes takes a tenth of its size in memory or less as a file, so Spark would collect millions of rows on the driver. ``F.broadcast`` still
    goes before this, and a join or a union of such tables needs it anew.
    """
    return df.hint("merge")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: worked out once, whatever reads it; ``growing``."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return growing(df.sparkSession.read.parquet(path))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, or one that fits a pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(p) or bool(system.globStatus(p))


def prefer_cached(spark: SparkSession, cached: str, raw: DataFrame) -> DataFrame:
    """The stage table at cached if it is there, else raw."""
    return spark.read.parquet(cached) if exists(spark, cached) else raw


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def feature_geometry(geometry: Column, to_grid: bool = False) -> dict[str, Column]:
    """``kind, px, py, parts`` of a geometry (type, coordinates as JSON text).

    parts is an array of polygons, each an array of rings, the outer one first. Degrees are put on the grid if asked.
    """
    at, kind = geometry["coordinates"], F.upper(geometry["type"])
    point = F.from_json(at, "array<double>")
    polygon = F.from_json(at, "array<array<array<double>>>")
    several = F.from_json(at, "array<array<array<array<double>>>>")
    parts = F.when(kind == "POLYGON", F.array(polygon)).when(kind == "MULTIPOLYGON", several)
    rings = F.transform(parts, lambda rs: F.transform(rs, _points))
    x, y = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    if to_grid:
        placed = lambda p: F.struct(*[c.alias(n) for c, n in zip(geo.wgs84_to_grid(p["x"], p["y"]), ("x", "y"))])
        rings = F.transform(rings, lambda rs: F.transform(rs, lambda r: F.transform(r, placed)))
        x, y = geo.wgs84_to_grid(x, y)
    is_point = kind == "POINT"
    return {"kind": kind, "px": F.when(is_point, x), "py": F.when(is_point, y), "parts": rings}


def scan_geojson(spark: SparkSession, path: str, properties: str, geometry: bool = False, to_grid: bool = False) -> DataFrame:
    """One row per feature of collections under path: the properties (a DDL string) and, if asked, ``kind, px, py, parts, ring``.

    parts has all polygons with their holes, ring is the outer ring of the first. Files that are not JSON, or not there, give no row.
    A large collection is read by many tasks.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL(properties))
    rows = read_features(spark, path, f"properties struct<{properties}>, geometry struct<type:string, coordinates:string>")
    if not geometry:
        return rows.select("f.properties.*")
    shape = feature_geometry(F.col("f.geometry"), to_grid)
    return rows.select("f.properties.*", *[c.alias(n) for n, c in shape.items()]).withColumn("ring", F.get(F.get("parts", F.lit(0)), F.lit(0)))


def scan_features(spark: SparkSession, path: str, properties: str, to_grid: bool = False) -> DataFrame:
    """Line-delimited features, as write_features lays them out: properties and ``kind, px, py, parts``."""
    schema = f"properties struct<{properties}>, geometry struct<type:string, coordinates:string>"
    rows = spark.read.schema(schema).json(path)
    return rows.select("properties.*", *[c.alias(n) for n, c in feature_geometry(F.col("geometry"), to_grid).items()])


def scan_points_csv(spark: SparkSession, path: str, schema: str | StructType, x: str, y: str) -> DataFrame:
    """Rows of a CSV file that have both coordinates."""
    return spark.read.schema(schema).csv(path, header=True, encoding="UTF-8").dropna(subset=[x, y]).withColumnsRenamed({x: "px", y: "py"})


def wkb_points(df: DataFrame, column: str) -> DataFrame:
    """df with px, py of a column of WKB points, decoded in batches; anything else, and points without coordinates, give nulls."""

    @F.arrow_udf("struct<x:double,y:double>")
    def decode(data: pa.Array) -> pa.Array:
        rows = [bytes(x) if x is not None and len(x) >= 21 else bytes(21) for x in data.to_pylist()]
        raw = np.frombuffer(b"".join(x[:21] for x in rows), np.dtype([("order", "u1"), ("kind", "V4"), ("x", "V8"), ("y", "V8")]))
        little = raw["order"] == 1
        field = lambda name, kind: np.where(little, np.ascontiguousarray(raw[name]).view(f"<{kind}"), np.ascontiguousarray(raw[name]).view(f">{kind}"))
        with np.errstate(invalid="ignore"):
            x, y = field("x", "f8").astype(float), field("y", "f8").astype(float)
        good = (field("kind", "u4") & 0xFF == 1) & np.isfinite(x) & np.isfinite(y) & np.array([v is not None and len(v) >= 21 for v in data.to_pylist()], bool)
        return pa.StructArray.from_arrays([pa.array(np.where(good, x, 0.0), mask=~good), pa.array(np.where(good, y, 0.0), mask=~good)], ["x", "y"])

    return df.withColumn("__p", decode(F.col(column))).withColumns({"px": F.col("__p.x"), "py": F.col("__p.y")}).drop("__p", column)


def primary(column: Column, kind: str) -> Column:
    """The primary value of a struct column, or the column itself where it is plain text."""
    return column["primary"] if kind.startswith("struct") else column.cast("string")


def scan_places(spark: SparkSession, path: str) -> DataFrame:
    """Places with a prefixed id, the primary name and category, the tags of the category, and their point; without a point: left out.

    names and categories may be structs with a primary value or plain text.
    """
    raw = spark.read.parquet(path)
    kinds = dict(raw.dtypes)
    rows = raw.select(F.concat(F.lit("ovt_"), F.col("id").cast("string")).alias("osmid"), primary(F.col("names"), kinds["names"]).alias("name"), primary(F.col("categories"), kinds["categories"]).alias("category"), F.col("geometry"))
    amenity, shop = tx.place_bucket(F.col("category"))
    return wkb_points(rows, "geometry").where("px IS NOT NULL").withColumns({"amenity": amenity, "shop": shop})


def scan_esri_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones of all files under path: label, description and outer ring; features without a ring are left out."""
    rows = read_features(spark, path, "attributes struct<ZONE_LABEL:string,DESC_ENG:string>, geometry struct<rings:array<array<array<double>>>>")
    ring = F.transform(F.get(F.col("f.geometry.rings"), F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return rows.select(F.col("f.attributes.ZONE_LABEL").alias("zone_label"), F.col("f.attributes.DESC_ENG").alias("description"), ring.alias("ring")).where("ring IS NOT NULL")


def keyword_dim(spark: SparkSession, path: str, fold: tuple[str, str] = ("", "")) -> DataFrame:
    """``keyword, main, sub`` of a keyword file (main: sub: list), folded and in lower case; of a keyword in two classes the later entry stays."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    mains = text.select(F.posexplode(F.map_entries("m")).alias("i", "e")).where("e.key NOT LIKE '\\_\\_%'").select("i", F.col("e.key").alias("main"), F.from_json("e.value", "map<string,array<string>>").alias("s"))
    subs = mains.select("i", "main", F.posexplode(F.map_entries("s")).alias("j", "e")).select("i", "j", "main", F.col("e.key").alias("sub"), F.posexplode("e.value").alias("k", "keyword"))
    order = F.struct("i", "j", "k")
    word = F.trim(F.lower(F.translate("keyword", *fold) if fold[0] else F.col("keyword")))
    return subs.where(word != "").groupBy(word.alias("keyword")).agg(F.max(F.struct(order.alias("o"), "main", "sub")).alias("x")).select("keyword", "x.main", "x.sub")


def strong_keywords(spark: SparkSession, path: str) -> DataFrame:
    """``keyword``: the strong keywords of a keyword file, in lower case."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return text.select(F.explode(F.from_json(F.col("m")["__STRONG_KEYWORDS__"], "array<string>")).alias("k")).select(F.trim(F.lower("k")).alias("keyword")).distinct()


def phrase_table(spark: SparkSession, path: str) -> DataFrame:
    """``phrase, to`` of phrase files: a phrase, a tab, its conversions parted by blanks, of which the first counts; other lines are skipped."""
    line = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.contains("value", F.lit("\t")))
    return rows.select(line[0].alias("phrase"), F.split(line[1], " ")[0].alias("to")).where("phrase <> ''")


def sanitized(df: DataFrame) -> DataFrame:
    """Columns fit for a text sink: nested ones as JSON, NaN, infinities, nulls and the text nan empty."""
    out = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            out[name] = F.coalesce(F.to_json(c), F.lit(""))
        elif kind in ("double", "float"):
            out[name] = F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit("")).otherwise(c.cast("string"))
        else:
            t = F.coalesce(c.cast("string"), F.lit(""))
            out[name] = F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)
    return df.select(*[c.alias(n) for n, c in out.items()])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header that begins with a byte order mark, so that spreadsheets take it for UTF-8."""
    rows = sanitized(df)
    rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that write_csv wrote, columns by place; empty values are null."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_audit_sheet(sample: DataFrame, path: str, asked: list[str]) -> None:
    """A sampled sheet with empty columns for what people are to fill in."""
    write_csv(sample.withColumns({c: F.lit("") for c in asked}), path)


def persist_training(features: DataFrame, labels: DataFrame, key: str, path: str) -> DataFrame:
    """Write features, labels and the training rows (both) as tables under path; returns the metadata row, written there too.

    ``rows, training_rows, columns, positives`` (label: number of ones).
    """
    names = [c for c in labels.columns if c != key]
    features.write.mode("overwrite").parquet(f"{path}/x")
    labels.write.mode("overwrite").parquet(f"{path}/y")
    spark = features.sparkSession
    x, y = spark.read.parquet(f"{path}/x"), spark.read.parquet(f"{path}/y")
    x.join(y, key).write.mode("overwrite").parquet(f"{path}/training")
    both = spark.read.parquet(f"{path}/training")
    positives = F.create_map(*[c for n in names for c in (F.lit(n), F.sum(F.coalesce(F.col(n), F.lit(0)).cast("long")))])
    meta = x.agg(F.count("*").alias("rows"), F.lit(1).alias("k")).join(both.agg(F.count("*").alias("training_rows"), positives.alias("positives"), F.lit(1).alias("k")), "k")
    meta = meta.select("rows", "training_rows", F.array(*[F.lit(c) for c in x.columns if c != key]).alias("columns"), "positives")
    meta.write.mode("overwrite").parquet(f"{path}/metadata")
    return spark.read.parquet(f"{path}/metadata")


def write_features(df: DataFrame, path: str, geometry: Column, drop: list[str]) -> None:
    """Line-delimited features: one JSON object a row."""
    properties = F.struct(*[F.col(c) for c in df.columns if c not in drop])
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value")).write.mode("overwrite").text(path)


def ensure_columns(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a DDL schema, those it lacks as typed nulls."""
    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
