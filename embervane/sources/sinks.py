"""Write-back of scores and other outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def unscored(df: DataFrame, cols: list[str], id_col: str = "sample_id") -> DataFrame:
    """Ids with any of ``cols`` null (a missing column is all null), each once."""
    for c in cols:
        df = df if c in df.columns else df.withColumn(c, F.lit(None))
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    return df.where(any_null).dropDuplicates([id_col])


def merge_scores(rows: DataFrame, scores: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows with new scores where there are any, else their old ones; scores repeat over a sample's time steps."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in cols])
    one = scores.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    one = one.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    out = rows.join(one, keys, "left")
    for c in cols:
        old = F.col(c) if c in rows.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_n_{c}"), old))
    return out.drop("_new", *[f"_n_{c}" for c in cols])


def write_long(df: DataFrame, path: str, ref: str = "ref_id", order: list[str] | None = None) -> None:
    """Only the datasets that ``df`` holds are replaced."""
    order = order or [c for c in ("sample_id", "timestamp") if c in df.columns]
    df.repartition(ref).sortWithinPartitions(ref, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(ref).parquet(path)


def changed(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """New rows any of whose values differs (null-safe) or that are new."""
    o = old.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in cols])
    differs = F.col("_old").isNull()
    for c in cols:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return new.join(o, keys, "left").where(differs).select(*keys, *cols)


def crosstab_long(df: DataFrame, keys: list[str], a: str = "S_anomaly", b: str = "anomaly_flag") -> DataFrame:
    return df.groupBy(*keys, a, b).agg(F.count("*").alias("n"))


def crosstab_wide(long: DataFrame, keys: list[str], a: str = "S_anomaly", b: str = "anomaly_flag", values: list[str] | None = None) -> DataFrame:
    """One row for each key (null keys go), one column for each pair of grades, 0 where there is none."""
    named = long.dropna(subset=keys).withColumn("_p", F.concat(F.lit("S="), F.col(a), F.lit("__C="), F.col(b)))
    return named.groupBy(*keys).pivot("_p", values).agg(F.sum("n")).fillna(0)


def unify(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column of unlike types becomes float (numbers), else timestamp, boolean or string, whichever fits all."""
    kinds: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, []).append(f.dataType)

    def target(types: list[T.DataType]) -> T.DataType:
        if len({t.simpleString() for t in types}) == 1:
            return types[0]
        if all(isinstance(t, T.NumericType) for t in types):
            return T.FloatType()
        if all(isinstance(t, (T.TimestampType, T.DateType)) for t in types):
            return T.TimestampType()
        return T.BooleanType() if all(isinstance(t, T.BooleanType) for t in types) else T.StringType()

    cast = {n: target(t) for n, t in kinds.items()}
    out = None
    for df in frames:
        one = df.select(*[F.col(c).cast(cast[c]).alias(c) for c in df.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def to_wide(df: DataFrame, key: str, step: str, values: list[str], steps: list) -> DataFrame:
    """Time steps as columns: {value}_{step}, the first value of each."""
    return df.groupBy(key).agg(*[F.first(F.when(F.col(step) == s, F.col(v)), ignorenulls=True).alias(f"{v}_{s}") for v in values for s in steps])


def add_stub(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in cols if c not in df.columns})


def write_regions(df: DataFrame, path: str, region: str = "region") -> None:
    df.withColumn(region, F.replace(region, F.lit(" "), F.lit("_"))).write.mode("overwrite").partitionBy(region).parquet(path)


def missing_csv(df: DataFrame, path: str, by: str = "ref_id") -> None:
    df.groupBy(by).agg(F.count("*").alias("n_missing")).write.mode("overwrite").csv(path, header=True)


def with_point(df: DataFrame, lon: str = "lon", lat: str = "lat", out: str = "geometry") -> DataFrame:
    """Adds a point as well-known binary (little-endian); rows without coordinates go."""
    return df.dropna(subset=[lon, lat]).mapInPandas(_wkb(lon, lat, out), T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def _wkb(lon: str, lat: str, out: str):
    def run(batches):
        import struct

        for pdf in batches:
            pdf[out] = [struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(pdf[lon], pdf[lat])]
            yield pdf

    return run


def copy_geo_footer(source: str, target: str) -> None:
    """One (local) file's ``geo`` metadata put on another; the writer of DataFrames has no way to."""
    import pyarrow.parquet as pq

    geo = (pq.read_schema(source).metadata or {}).get(b"geo")
    if geo is not None:
        t = pq.read_table(target)
        pq.write_table(t.replace_schema_metadata({**(t.schema.metadata or {}), b"geo": geo}), target, compression="zstd")


def coverage(df: DataFrame, by: str, col: str) -> DataFrame:
    have = F.sum(F.col(col).isNotNull().cast("int"))
    return df.groupBy(by).agg(F.count("*").alias("total"), have.alias("present"), F.round(100.0 * have / F.count("*"), 1).alias("pct"))


def swap_in(spark: SparkSession, stage: str, path: str) -> None:
    """A finished staging folder takes the place of ``path``."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(stage), jvm.org.apache.hadoop.fs.Path(path)
    fs = a.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.delete(b, True)
    fs.rename(a, b)
