"""The stored vector collection: upserts and deletes that replace only the buckets they touch.

A collection is a folder of Parquet files in ``buckets`` folders by the hash of the vector's
id, so that an id lies in one whatever document it belongs to. A write reads the buckets it
touches, puts their new rows into a staging folder beside the collection, and overwrites just
these buckets; repeating a write gives the same collection. Documents are deleted from the
buckets that hold them, which two columns tell. Vectors have one width, which the first write sets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators.dense import ensure_width

BUCKETS = 256


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a collection with a vector in it."""
    fs, p = _files(spark, path)
    return fs.exists(p) and any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(p))


def _bucket(by: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int").alias("bucket")


def _replace(rows: DataFrame, touched: DataFrame, path: str) -> None:
    """Make rows the only ones of the touched buckets."""
    spark = rows.sparkSession
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    rows.write.parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    fs, _ = _files(spark, path)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    # a bucket that has lost all its rows is not overwritten, but deleted; buckets are a bounded number
    for r in touched.join(staged.select("bucket").distinct(), "bucket", "left_anti").collect():
        fs.delete(_files(spark, f"{path.rstrip('/')}/bucket={r[0]}")[1], True)
    fs.delete(_files(spark, staging)[1], True)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert(vectors: DataFrame, path: str, id_col: str = "vec_id", by: str = "document_id", vector: str = "embedding", buckets: int = BUCKETS) -> None:
    """Write vectors: one whose id is there replaces it, also if it was another document's; of an id that repeats the one of the greatest document stays.

    Raises DimensionMismatch if widths differ, before anything is written.
    """
    spark = vectors.sparkSession
    there = exists(spark, path)
    ensure_width(vectors, vector, ensure_width(read(spark, path), vector) if there else None)
    one = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc_nulls_last(by), F.desc(F.col(vector).cast("string"))))
    new = vectors.withColumn("_n", one).where("_n = 1").drop("_n").withColumn("bucket", _bucket(id_col, buckets))
    touched = new.select("bucket").distinct()
    rows = new
    if there:
        kept = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(new.select(id_col), id_col, "left_anti")
        rows = kept.unionByName(new, allowMissingColumns=True)
    _replace(rows, touched, path)


def delete_documents(spark: SparkSession, path: str, documents: DataFrame, by: str = "document_id") -> None:
    """Delete the vectors of a table of documents; nothing happens where there is no collection."""
    if not exists(spark, path):
        return
    gone = documents.select(by).distinct()
    there = spark.read.parquet(path)
    touched = spark.createDataFrame([(r[0],) for r in there.select(by, "bucket").join(gone, by, "left_semi").select("bucket").distinct().collect()], "bucket int")  # buckets are a bounded number
    _replace(there.join(touched, "bucket", "left_semi").join(gone, by, "left_anti"), touched, path)
