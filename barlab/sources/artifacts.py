"""Versioned tables that are read only as they were committed.

A commit writes a new version's files, reads them back, and records what they
hold (rows and fingerprint of each part, and the schema) in a manifest beside
them. Only then an entry in the log points to the version, by a rename, so a
job that dies before has changed nothing. A reader takes the last entry, adds
up the parts that it reads again, and refuses data that are not those of the
manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barlab.operators.quality import dataset_diff


class Damaged(ValueError):
    """A version's files are not what its manifest says."""


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def contents(df: DataFrame, parts: list[str]) -> DataFrame:
    """Rows and fingerprint of each part: the exact sum of the rows' hashes, so neither order nor layout counts, but a repeated row does."""
    plain = sorted(c for c in df.columns if c not in parts)
    one = F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0).cast("long")
    return df.groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"), F.sum(one.cast("decimal(38,0)")).alias("fingerprint"))


def log(spark: SparkSession, root: str) -> list[dict]:
    """Entries of the commits so far, the oldest first."""
    system, place = _system(spark, f"{root}/log")
    if not system.exists(place):
        return []
    names = sorted(x.getPath().getName() for x in system.listStatus(place) if x.getPath().getName().endswith(".json"))
    return [json.loads(spark.read.text(f"{root}/log/{n}", wholetext=True).first()[0]) for n in names]


def commit(df: DataFrame, root: str, *, parts: list[str] | None = None, about: dict | None = None) -> int:
    """Store ``df`` as the next version of the table at ``root``, with a folder for each value of ``parts``; its number, from 1.

    Of two commits at once one gets the number and the other an error; neither
    mixes with what readers see. ``about``: further entries of the log.
    """
    spark, parts = df.sparkSession, parts or []
    version = uuid.uuid4().hex
    data = f"{root}/versions/{version}/data"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(data)
    back = spark.read.schema(df.schema).parquet(data)
    contents(back, parts).write.parquet(f"{root}/versions/{version}/manifest")
    number = len(log(spark, root)) + 1
    entry = {"number": number, "version": version, "parts": parts, "schema": json.loads(df.schema.json()), **(about or {})}
    system, temporary = _system(spark, f"{root}/versions/{version}/entry")
    _, final = _system(spark, f"{root}/log/{number:08d}.json")
    system.mkdirs(final.getParent())
    out = system.create(temporary, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if system.exists(final) or not system.rename(temporary, final):
        raise FileExistsError(f"version {number} of {root} has been committed by another job")
    return number


def open_table(spark: SparkSession, root: str, *, number: int | None = None, where: str | None = None) -> DataFrame:
    """The last committed version of a table (or the one with that number), after its parts' rows and fingerprints were found unchanged.

    ``where``: a condition on the parts; only the parts that it leaves are
    read and checked.
    """
    entries = log(spark, root)
    chosen = entries[-1:] if number is None else [e for e in entries if e["number"] == number]
    if not chosen:
        raise FileNotFoundError(f"{root} holds no such version")
    entry = chosen[0]
    folder, schema = f"{root}/versions/{entry['version']}", T.StructType.fromJson(entry["schema"])
    some = lambda df: df.where(where) if where else df
    data = some(spark.read.schema(schema).parquet(f"{folder}/data"))
    parts = entry["parts"]
    one = F.lit(0).alias("__all")
    named = lambda df: some(df) if parts else df.select(one, "*")
    wrong = dataset_diff(named(spark.read.parquet(f"{folder}/manifest")), named(contents(data, parts)), parts or ["__all"])
    found = wrong.limit(5).collect()
    if found:
        raise Damaged(f"{root}, version {entry['number']}: " + "; ".join(str(r.asDict()) for r in found))
    return data.select(*schema.names)
