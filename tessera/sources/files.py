"""CSV, JSON and GeoJSON releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions.coerce import norm_code, to_double_marked
from ..operators.tidy import LayoutError, union_all


def read_census_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: census CSV; the last column must be ``Observation``."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    cols = [c.strip() for c in df.columns]
    if not cols or cols[-1] != "Observation":
        raise LayoutError(f"census CSV must end with an Observation column, got {cols[-1:]}")
    df = df.toDF(*cols)
    return df.withColumn("Observation", F.col("Observation").try_cast("bigint"))


# The rents CSV contract (published column -> tidy column).
RENTS_COLUMNS = {
    "v4_1": "value",
    "Data Marking": "data_marking",
    "mmm-yy": "month_label",
    "Time": "time_period",
    "administrative-geography": "geography_code",
    "Geography": "geography_name",
    "index-and-year-change": "variable",
    "IndexAndYearChange": "variable_label",
}
RENTS_ORDER = ["geography_code", "geography_name", "variable", "variable_label", "time_period", "month_label", "value", "data_marking"]


def rents_contract(df: DataFrame) -> DataFrame:
    """Rename the 8 published columns (the first may carry another name), blank marking -> NULL."""
    cols = [c.strip() for c in df.columns]
    df = df.toDF(*cols)
    unknown = [c for c in cols if c not in RENTS_COLUMNS]
    if unknown:
        if len(cols) == len(RENTS_COLUMNS) and unknown == [cols[0]]:
            df = df.withColumnRenamed(cols[0], "v4_1")
        else:
            raise LayoutError(f"unexpected CSV columns: {unknown}")
    missing = [c for c in RENTS_COLUMNS if c not in df.columns]
    if missing:
        raise LayoutError(f"missing columns: {missing}")
    out = df.withColumnsRenamed(RENTS_COLUMNS)
    out = out.withColumn("value", to_double_marked("value")).withColumn(
        "data_marking", F.when(F.trim("data_marking") == "", F.lit(None)).otherwise(F.col("data_marking"))
    )
    return out.select(*RENTS_ORDER)


def read_rents_csv(spark: SparkSession, path: str) -> DataFrame:
    return rents_contract(spark.read.option("header", "true").option("encoding", "UTF-8").csv(path))


def read_lookup(spark: SparkSession, path: str | None, fallback: DataFrame | None = None,
                code_col: str = "LAD code", region_col: str = "Region name") -> DataFrame:
    """LAD -> region lookup from CSV; otherwise derived from a fact table (J9 via ``fallback``)."""
    if path:
        try:
            df = spark.read.option("header", "true").csv(path)
        except AnalysisException as e:
            if fallback is None or e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            return df.select(norm_code(code_col).alias("lad_code"), F.trim(F.col(region_col)).alias("region_name")).dropDuplicates(["lad_code"])
    if fallback is None:
        raise LayoutError("no lookup file and no fallback table")
    return fallback


def read_reports(spark: SparkSession, folder: str, glob: str = "ts_backtest_*.json") -> DataFrame:
    """JSON report documents; malformed files are kept as ``_corrupt_record`` rows and dropped."""
    df = (
        spark.read.option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", glob)
        .json(folder)
        .withColumn("file", F.input_file_name())
    )
    if "_corrupt_record" in df.columns:
        df = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return df


def union_predictions(frames: list[DataFrame]) -> DataFrame:
    """Prediction tables with different columns stacked by name."""
    return union_all(frames)


# Property names that may carry the authority code in boundary files,
# tried in order, and the default map box when no coordinates exist
# (min_lon, min_lat, max_lon, max_lat) = (-8.0, 49.5, 2.0, 61.0).
GEO_CODE_KEYS = ["LAD22CD", "LAD21CD", "lad_code"]
DEFAULT_BOUNDS = (-8.0, 49.5, 2.0, 61.0)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature with its code and the bounds of all its coordinates."""
    raw = spark.read.option("multiLine", "true").json(path)
    f = raw.select(F.explode("features").alias("f"))
    props = [k for k in GEO_CODE_KEYS if k in f.select("f.properties.*").columns] if "properties" in f.select("f.*").columns else []
    # First key with a non-empty value wins; codes are normalised.
    code = F.coalesce(*[F.nullif(F.trim(F.col(f"f.properties.{k}").cast("string")), F.lit("")) for k in props]) if props else F.lit(None).cast("string")
    code = norm_code(code)
    # Coordinates nest 2-4 levels deep (polygon / multipolygon); flatten to points.
    coords = F.col("f.geometry.coordinates")
    gtype = F.col("f.geometry.type")
    return f.select(code.alias("code"), gtype.alias("geometry_type"), F.to_json(coords).alias("_c"))


def geojson_bounds(features: DataFrame) -> DataFrame:
    """S10 bounds: min/max lon/lat over all features; the default box when there are none."""
    # a point is two numbers, or three with an altitude
    pairs = F.regexp_extract_all("_c", F.lit(r"\[(-?[0-9.eE+-]+),(-?[0-9.eE+-]+)(?:,-?[0-9.eE+-]+)?\]"), 0)
    pts = features.select(F.explode(pairs).alias("p")).select(
        F.regexp_extract("p", r"\[(-?[0-9.eE+-]+),", 1).cast("double").alias("lon"),
        F.regexp_extract("p", r"^\[[^,]+,(-?[0-9.eE+-]+)", 1).cast("double").alias("lat"),
    )
    b = pts.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
    d = DEFAULT_BOUNDS
    return b.select(
        F.coalesce("min_lon", F.lit(d[0])).alias("min_lon"), F.coalesce("min_lat", F.lit(d[1])).alias("min_lat"),
        F.coalesce("max_lon", F.lit(d[2])).alias("max_lon"), F.coalesce("max_lat", F.lit(d[3])).alias("max_lat"),
    )
