"""The unified results table: its columns, reading and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the results table by type, in file order: a fixed format.
COLUMNS = [
    ("exp_id", "string"), ("config_hash", "string"), ("git_commit", "string"), ("seed", "int"), ("split_seed", "int"), ("max_users", "int"), ("created_at", "string"),
    ("family", "string"), ("scope", "string"), ("arm_id", "string"), ("target_ref", "string"), ("result_id", "string"),
    ("epsilon", "double"), ("unit_m", "double"), ("known_points", "int"), ("n_shadow", "int"),
    ("metric", "string"), ("value", "double"), ("ci_low", "double"), ("ci_high", "double"), ("n_bootstrap", "int"),
    ("n_pool", "int"), ("n_gallery_users", "int"), ("n_probes", "int"), ("n_rematch_dropped", "int"), ("n_members", "int"), ("n_nonmembers", "int"), ("spent_budget", "double"),
    ("attack_runtime_s", "double"), ("peak_memory_mb", "double"), ("run_runtime_s", "double"),
]
NAMES = [n for n, _ in COLUMNS]
SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)
PROVENANCE = NAMES[:7]


def finite(c: Column | str) -> Column:
    """Null for NaN and the infinities."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def refuse_raw(path: str) -> None:
    """Raw data are never written to: a path with the segments data/raw is refused."""
    parts = path.replace("\\", "/").split("/")
    if any(a == "data" and b == "raw" for a, b in zip(parts, parts[1:])):
        raise ValueError(f"{path} lies under data/raw, which is read-only")


def write_results(df: DataFrame, path: str, provenance: dict | None = None) -> None:
    """CSV with all columns; undefined and missing values are blank. Provenance fills its columns on every row."""
    refuse_raw(path)
    if provenance is not None:
        if missing := [k for k in PROVENANCE if k not in provenance]:
            raise ValueError(f"provenance lacks {missing}")
        df = df.withColumns({k: F.lit(provenance[k]) for k in PROVENANCE})
    out = df.select(*[(finite(F.col(n).cast(t)) if t == "double" else F.col(n).cast(t)).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in COLUMNS])
    out.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of the text, on any file system that Spark knows; what was there is replaced."""
    refuse_raw(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at, True)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Results files as one table: headers must be exactly the columns; a blank value is NaN, other blanks are null."""
    for path in paths:
        head = spark.read.text(path).limit(1).collect()
        if not head or head[0][0].lstrip("﻿").split(",") != NAMES:
            raise ValueError(f"{path} has other columns than the results table")
    read = spark.read.option("header", True).option("enforceSchema", False).option("nullValue", "").schema(SCHEMA).csv(paths)
    return read.withColumn("value", F.coalesce("value", F.lit(float("nan")))).withColumn("metric_id", F.concat_ws(":", "result_id", "metric"))


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """run.json files, a row each; one that lacks a key or isn't JSON is an error that names it."""
    schema = "exp_id string, config_hash string, git_commit string, seed int, split_seed int, max_users int, created_at string, n_matched int, n_dropped int, split_counts map<string,int>, arms map<string,map<string,double>>, over_budget array<struct<result_id:string,attack_runtime_s:double>>, warnings array<string>, runtime_s double, metrics array<map<string,string>>, _corrupt string"
    read = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").schema(schema).json(paths).withColumn("path", F.col("_metadata.file_path"))
    needed = ("exp_id", "config_hash", "n_matched", "n_dropped", "split_counts", "metrics")
    bad = read.where(F.col("_corrupt").isNotNull() | F.array_contains(F.array(*[F.col(c).isNull() for c in needed]), True))
    if row := bad.select("path").first():
        raise ValueError(f"{row[0]} is not a run file")
    return read.drop("_corrupt")
