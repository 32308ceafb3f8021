"""Bundles: tables written together with a manifest of what each must hold, checked before they are read back, and old ones dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import _Folder


class BundleError(RuntimeError):
    """A bundle that is not what its manifest says."""


def table_digest(rows: DataFrame) -> DataFrame:
    """``n_rows, digest`` of a table: a sum of row hashes, whatever the order of rows and files; maps count by their sorted entries."""
    plain = [F.array_sort(F.map_entries(c)) if kind.startswith("map") else F.col(c) for c, kind in sorted(rows.dtypes)]
    return rows.select(F.xxhash64(*plain).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def write_bundle(tables: dict[str, DataFrame], folder: str, name: str) -> None:
    """Write tables and then the manifest ``table, n_rows, digest``; a bundle without a manifest is not finished."""
    spark = next(iter(tables.values())).sparkSession
    digests = None
    for table, rows in sorted(tables.items()):
        rows.write.parquet(f"{folder}/{name}/{table}")
        own = table_digest(spark.read.parquet(f"{folder}/{name}/{table}")).select(F.lit(table).alias("table"), "n_rows", "digest")
        digests = own if digests is None else digests.unionByName(own)
    digests.coalesce(1).write.parquet(f"{folder}/{name}/MANIFEST")


def bundle_problems(spark: SparkSession, folder: str, name: str) -> list[str]:
    """What of a bundle is not as its manifest says; a manifest that is missing is a problem too."""
    files = _Folder(spark, f"{folder}/{name}")
    if "MANIFEST" not in files.names():
        return ["no manifest"]
    listed = {r["table"]: (r["n_rows"], r["digest"]) for r in spark.read.parquet(f"{folder}/{name}/MANIFEST").collect()}
    there = {n for n in files.names() if n != "MANIFEST" and not n.startswith((".", "_"))}
    found = [f"{t}: missing" for t in sorted(set(listed) - there)] + [f"{t}: unexpected" for t in sorted(there - set(listed))]
    return found + [f"{t}: changed" for t in sorted(there & set(listed)) if tuple(table_digest(spark.read.parquet(f"{folder}/{name}/{t}")).first()) != listed[t]]


def restored(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """The tables of a bundle, if it is what its manifest says."""
    if problems := bundle_problems(spark, folder, name):
        raise BundleError(f"{name}: {'; '.join(problems)}")
    return {r["table"]: spark.read.parquet(f"{folder}/{name}/{r['table']}") for r in spark.read.parquet(f"{folder}/{name}/MANIFEST").collect()}


def prune_bundles(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Drop all finished bundles but the ``keep`` newest by name, and say which; unfinished ones stay for their writers."""
    if keep < 1:
        raise ValueError("at least one bundle is kept")
    files = _Folder(spark, folder)
    done = [n for n in files.names() if not n.startswith((".", "_")) and "MANIFEST" in files.names(n)]
    for name in done[:-keep]:
        files.drop(name)
    return done[:-keep]
