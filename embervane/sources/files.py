"""Files and class tables: discovery, mappings, CSV points, raster tiles."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, vectors


def discover(spark: SparkSession, folder: str, pattern: str = "*.parquet", ref_col: str = "ref_id") -> DataFrame:
    """All Parquet files below ``folder`` with ``ref_id``: the partition value of their path, else the file's stem."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        raise FileNotFoundError(folder)
    if fs.getFileStatus(p).isFile() and not folder.endswith(".parquet"):
        raise ValueError(f"{folder} is no Parquet file")
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(folder)
    name = F.input_file_name()
    part = F.regexp_extract(name, rf"{ref_col}=([^/]+)", 1)
    return df.withColumn(ref_col, F.when(part != "", part).otherwise(F.regexp_extract(name, r"([^/]+?)\.[^./]+$", 1)))


def has_columns(spark: SparkSession, path: str, cols: list[str]) -> bool:
    """Whether a saved result can be used again: its footer names all columns."""
    return set(cols) <= set(spark.read.parquet(path).columns)


def load_mapping(spark: SparkSession, source, labels: list[str], name: str | None = None) -> DataFrame:
    """(code, labels...) from a dict, JSON or CSV in five shapes: {code: label}, {code: [labels]}, {code: {label: value}},
    {name: {code: label}} and a list of records with a code column."""
    if isinstance(source, (str, Path)):
        path = str(source)
        if path.endswith(".csv"):
            df = spark.read.csv(path, header=True)
            return df.select(text.clean_code(F.col(df.columns[0])).alias("code"), *labels)
        if not path.endswith(".json"):
            raise ValueError(f"{path}: a mapping is JSON or CSV")
        with open(path) as f:
            source = json.load(f)
    if isinstance(source, list):
        code = next((c for c in source[0] if "code" in c.lower()), None) if source else None
        if code is None:
            raise ValueError("no code column")
        rows = [(str(r[code]), *[r.get(x, r.get("label")) for x in labels]) for r in source]
    else:
        if name and name in source:
            source = source[name]
        elif source and all(isinstance(v, dict) for v in source.values()) and not any(x in v for v in source.values() for x in labels):
            if len(source) < len(labels):
                raise ValueError("too few mappings")
            per = list(source.values())[: len(labels)]
            source = {k: [m.get(k) for m in per] for k in dict.fromkeys(k for m in per for k in m)}
        rows = []
        for k, v in source.items():
            v = [v.get(x) for x in labels] if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else [v]
            if len(v) != len(labels):
                raise ValueError(f"code {k}: {len(v)} labels instead of {len(labels)}")
            rows.append((str(k), *v))
    schema = ", ".join(["code string", *[f"`{x}` string" for x in labels]])
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("code", text.clean_code(F.col("code")))


def legend_mappings(legend: DataFrame, code: str, classes: list[str]) -> DataFrame:
    """(mapping, code, label): a legend's class columns as rows; blank labels go, the last of a repeated code wins."""
    rows = legend.withColumn("_i", F.monotonically_increasing_id()).select("_i", text.clean_code(F.col(code)).alias("code"), *classes)
    flat = rows.unpivot(["_i", "code"], classes, "mapping", "label").where(F.trim("label") != "")
    return flat.where(F.coalesce("code", F.lit("")) != "").groupBy("mapping", "code").agg(F.max_by("label", "_i").alias("label"))


MAX_MAPPING_ROWS = 1_000_000


def write_mappings(df: DataFrame, path: str) -> None:
    """(mapping, code, label) as JSON with sorted keys; a class table is small by nature, and beyond ``MAX_MAPPING_ROWS`` nothing is written."""
    out: dict[str, dict[str, str]] = {}
    rows = df.limit(MAX_MAPPING_ROWS + 1).collect()
    if len(rows) > MAX_MAPPING_ROWS:
        raise ValueError(f"{path}: more than {MAX_MAPPING_ROWS} rows of mappings")
    for r in rows:
        out.setdefault(r["mapping"], {})[r["code"]] = r["label"]
    with open(path, "w") as f:
        json.dump(out, f, indent=1, sort_keys=True)


def points_csv(spark: SparkSession, path: str, codes: dict[str, int], default: int, id_col: str = "sample_id") -> DataFrame:
    """Field points: coordinates of the field, else of the site; the crop's code, else the default; each id once."""
    df = spark.read.csv(path, header=True)
    num = lambda c: F.col(c).try_cast("double")
    m = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (k, v)])
    df = df.select(
        F.col(id_col).cast("string").alias("sample_id"), F.coalesce(num("field_lat"), num("site_lat")).alias("lat"), F.coalesce(num("field_lon"), num("site_lon")).alias("lon"),
        F.col("year").try_cast("int").alias("year"), F.coalesce(F.try_element_at(m, F.lower(F.trim("crop"))), F.lit(default)).alias("label_code"),
    )
    return df.dropna(subset=["sample_id", "lat", "lon", "year"]).dropDuplicates(["sample_id"])


def points_in_tiles(points: DataFrame, tiles: DataFrame, id_col: str = "sample_id", step: float = 1.0) -> DataFrame:
    """Each point with the first tile of its year whose box holds it (strictly inside before on the edge, then by name).

    Boxes are spread over grid buckets of ``step`` degrees, so it is an equi-join; a hot bucket is split by AQE.
    """
    b = lambda c: F.floor(c / step).cast("long")
    t = tiles.withColumn("_bx", F.explode(F.sequence(b(F.col("x0")), b(F.col("x1"))))).withColumn("_by", F.explode(F.sequence(b(F.col("y0")), b(F.col("y1")))))
    p = points.withColumns({"_bx": b(F.col("lon")), "_by": b(F.col("lat"))})
    hit = p.join(t, ["year", "_bx", "_by"]).where("lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1")
    inside = (F.col("lon") > F.col("x0")) & (F.col("lon") < F.col("x1")) & (F.col("lat") > F.col("y0")) & (F.col("lat") < F.col("y1"))
    w = Window.partitionBy(id_col).orderBy((~inside).cast("int"), "tile")
    return hit.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_bx", "_by", "x0", "x1", "y0", "y1")


def heavy_tiles(points: DataFrame, tile: str = "tile", at: int = 1000) -> DataFrame:
    """Adds ``heavy``: whether the point's tile has at least ``at`` points."""
    return points.withColumn("heavy", F.count("*").over(Window.partitionBy(tile)) >= at)


def sampled_bands(df: DataFrame, bands: str = "bands") -> DataFrame:
    """Integer bands to a vector, and whether it is valid."""
    v = vectors.dequantise(bands)
    return df.withColumn("embedding", v).withColumn("valid", F.col("embedding").isNotNull())
