"""Catalogues that grow by month: months are written aside, checked, and named by one new manifest.

A catalogue is a folder of builds and of numbered manifests.  Each manifest lists, for every month, the build that holds it, its files and rows.
A build that stops half way leaves files that no manifest names; readers see the last manifest's months, whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("product", "h", "year", "month")
Month = tuple[str, float, int, int]


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    system, where = _fs(spark, f"{path}/manifests")
    if not system.exists(where):
        return []
    names = [f.getPath().getName() for f in system.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str) -> dict[Month, dict]:
    """The months of the newest manifest: month -> build, files and rows; none for a catalogue that doesn't exist yet."""
    versions = _versions(spark, path)
    if not versions:
        return {}
    body = spark.read.text(f"{path}/manifests/{versions[-1]}.json", wholetext=True).first()[0]
    return {tuple(m[k] for k in KEY): m for m in json.loads(body)["months"]}


def _publish(spark: SparkSession, path: str, months: dict[Month, dict], version: int) -> None:
    system, temporary = _fs(spark, f"{path}/manifests/{uuid.uuid4().hex}.tmp")
    out = system.create(temporary, True)
    out.write(bytearray(json.dumps({"months": [months[m] for m in sorted(months)]}).encode()))
    out.close()
    _, final = _fs(spark, f"{path}/manifests/{version}.json")
    if system.exists(final) or not system.rename(temporary, final):
        system.delete(temporary, False)
        raise RuntimeError(f"another build has written manifest {version} of {path}")


def commit(storms: DataFrame, path: str, parameters: dict, months: list[Month] | None = None) -> list[Month]:
    """Add the months of ``storms`` (year, month, ...) or replace them; they appear together, or not at all.

    What was written is read again before the manifest names it.  Of ``months`` that were built, those without a storm are
    named too, as empty ones.  The months named are returned.
    """
    spark, version, build = storms.sparkSession, (_versions(storms.sparkSession, path) or [0])[-1] + 1, uuid.uuid4().hex
    out = storms
    for name, value in parameters.items():
        out = out.withColumn(f"param_{name}", F.lit(value))
    out = out.withColumn("product", F.lit(str(parameters.get("product", "final")))).withColumn("h", F.lit(float(parameters.get("prominence") or 0.0)))
    where = f"{path}/build={build}"
    out.write.partitionBy(*KEY).parquet(where)
    system, folder = _fs(spark, where)
    filled = any(f.isDirectory() and "=" in f.getPath().getName() for f in system.listStatus(folder))
    back = [] if not filled else spark.read.parquet(where).select(*KEY, F.col("_metadata.file_name").alias("file")).groupBy(*KEY).agg(F.count("*").alias("rows"), F.count_distinct("file").alias("files")).collect()
    made = {tuple(r[k] for k in KEY): {**{k: r[k] for k in KEY}, "build": build, "rows": r["rows"], "files": r["files"]} for r in back}
    made = {**{m: {**dict(zip(KEY, m)), "build": build, "rows": 0, "files": 0} for m in months or []}, **made}
    _publish(spark, path, {**manifest(spark, path), **made}, version)
    return sorted(made)


def _leaf(path: str, m: dict) -> str:
    return f"{path}/build={m['build']}/product={m['product']}/h={m['h']}/year={m['year']}/month={m['month']}"


def read(spark: SparkSession, path: str, months: list[Month] | None = None) -> DataFrame | None:
    """The storms of the newest manifest, or of some of its months; None where it has none of them."""
    held = manifest(spark, path)
    leaves = [_leaf(path, held[m]) for m in (held if months is None else months) if m in held and held[m]["files"]]
    return spark.read.option("basePath", path).parquet(*leaves).drop("build") if leaves else None


def broken(spark: SparkSession, path: str) -> list[Month]:
    """Months that the manifest names and whose files are gone or cut short: Parquet begins and ends with four fixed bytes."""
    held, bad = manifest(spark, path), []
    there = {}
    for month, m in held.items():
        system, leaf = _fs(spark, _leaf(path, m))
        there[month] = [f.getPath().toString() for f in system.listStatus(leaf) if f.getPath().getName().endswith(".parquet")] if system.exists(leaf) else []
        if len(there[month]) != m["files"]:
            bad.append(month)
    files = [f for month in held if month not in bad for f in there[month]]
    if not files:
        return sorted(bad)
    content = spark.read.format("binaryFile").load(files).withColumn("ok", (F.col("length") > 8) & (F.substring("content", 1, 4) == F.lit(b"PAR1")) & (F.expr("substring(content, -4)") == F.lit(b"PAR1")))
    cut = {r["path"] for r in content.where("NOT ok").select("path").collect()}
    return sorted([*bad, *(month for month in held if month not in bad and any(f in cut for f in there[month]))])


def missing(spark: SparkSession, path: str, wanted: list[Month]) -> list[Month]:
    """The wanted months that the catalogue lacks or can't read, in order: what a build has still to do."""
    bad, held = set(broken(spark, path)), manifest(spark, path)
    return [m for m in wanted if m not in held or m in bad]
