"""A stored table of documents that writes are checked against without shuffling it.

The table is bucketed and sorted by its key, so that a join with new rows moves only the new
ones. Its files carry Bloom filters of the key's last column, so that a look-up of a few
contents skips the row groups that hold none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.write import new_documents, upserted

BUCKETS = 64
KEY = ("tenant_id", "sha256")


def _bucketed(df: DataFrame, table: str, key: tuple[str, ...], buckets: int, mode: str, path: str | None) -> None:
    writer = df.repartition(buckets, *key).write.mode(mode).format("parquet").bucketBy(buckets, *key).sortBy(*key).option(f"parquet.bloom.filter.enabled#{key[-1]}", "true")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def create(documents: DataFrame, table: str, path: str | None = None, key: tuple[str, ...] = KEY, buckets: int = BUCKETS) -> None:
    """Store rows as a bucketed table, at a path or in the session's warehouse."""
    _bucketed(documents, table, key, buckets, "errorifexists", path)


def append(documents: DataFrame, table: str, path: str | None = None, key: tuple[str, ...] = KEY, buckets: int = BUCKETS) -> None:
    """Add rows to the table, bucketed as it is."""
    _bucketed(documents, table, key, buckets, "append", path)


def stored(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def insert_or_get(uploads: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """uploads with created and stands, against what the table holds; the table is read in its buckets, and uploads move once, into as many."""
    return new_documents(uploads.repartition(buckets, *KEY), uploads.sparkSession.table(table))


def upsert(changes: DataFrame, table: str, key: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """The table's rows with changes by key (see upserted); the stored side is read in its buckets."""
    return upserted(changes.sparkSession.table(table), changes, list(key), list(keep))


def lookup(spark: SparkSession, table: str, hashes: list[str], column: str = "sha256", most: int = 1000) -> DataFrame:
    """Rows of a few contents, by a filter that reaches the files' Bloom filters; more than so many are a join's work."""
    if len(hashes) > most:
        raise ValueError(f"{len(hashes)} hashes are too many for a filter; join a table of them")
    return spark.table(table).where(F.col(column).isin(hashes))
