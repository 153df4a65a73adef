"""Trajectory and network files as DataFrames, and a registry of loaders."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .results import refuse_raw

HEADER_LINES, FIELDS = 6, 7


def read_plt(spark: SparkSession, root: str, dataset: str = "geolife") -> DataFrame:
    """(traj_id, user_id, dataset_id, points, start_t, end_t, n_points, source_file) of <root>/Data/<user>/Trajectory/*.plt.

    Six header lines; then latitude, longitude, 0, altitude, day number, date, time. Lines
    of another number of fields or with a field that doesn't parse are left out; so are
    files without a point. Times are UTC.
    """
    files = spark.read.text(f"{root.rstrip('/')}/Data/*/Trajectory/*.plt", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    user, stem = F.regexp_extract("path", r"/Data/([^/]+)/Trajectory/", 1), F.regexp_extract("path", r"/([^/]+)\.plt$", 1)
    lines = files.select("path", user.alias("user_id"), stem.alias("stem"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where(F.col("pos") >= HEADER_LINES)
    parts = F.split("line", ",")
    lines = lines.withColumn("f", parts).where(F.size("f") == FIELDS)
    part = lambda i: F.trim(F.col("f")[i])
    when = F.try_to_timestamp(F.concat_ws(" ", part(5), part(6)), F.lit("yyyy-MM-dd HH:mm:ss"))
    point = F.struct(part(0).try_cast("double").alias("lat"), part(1).try_cast("double").alias("lon"), F.unix_timestamp(when).cast("double").alias("t"))
    good = lines.withColumn("p", point).where("p.lat IS NOT NULL AND p.lon IS NOT NULL AND p.t IS NOT NULL")
    made = good.groupBy("path", "user_id", "stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"]).alias("points"))
    points = F.col("points")
    return made.select(F.concat_ws("/", F.lit(dataset), "user_id", "stem").alias("traj_id"), "user_id", F.lit(dataset).alias("dataset_id"), "points", points[0]["t"].alias("start_t"), F.element_at(points, -1)["t"].alias("end_t"), F.size(points).alias("n_points"), F.col("path").alias("source_file"))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML road network; edge_id is the order in the document.

    Attribute keys are looked up by name in the document's own declarations.
    """
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    names = {(r["_for"], r["_attr.name"]): r["_id"] for r in rows("key", "_id string, _for string, `_attr.name` string").collect()}
    data = "data array<struct<_VALUE:string,_key:string>>"

    def value(of: str, name: str):
        at = names.get((of, name))
        return F.lit(None).cast("string") if at is None else F.get(F.filter("data", lambda d: d["_key"] == at), F.lit(0))["_VALUE"]

    nodes = rows("node", f"_id string, {data}").select(F.col("_id").cast("bigint").alias("node_id"), *[value("node", c).cast("double").alias(c) for c in ("x", "y", "lon", "lat")], value("node", "street_count").cast("int").alias("street_count"))
    edges = rows("graph", f"edge array<struct<_id:string,_source:string,_target:string,{data.replace(' ', ':', 1)}>>").select(F.posexplode("edge").alias("edge_id", "e")).select("edge_id", F.col("e._source").cast("bigint").alias("u"), F.col("e._target").cast("bigint").alias("v"), F.coalesce(F.col("e._id").try_cast("int"), F.lit(0)).alias("key"), F.col("e.data").alias("data"))
    edges = edges.select(F.col("edge_id").cast("bigint").alias("edge_id"), "u", "v", "key", value("edge", "length").cast("double").alias("length_m"), value("edge", "highway").alias("highway"), F.lower(value("edge", "oneway")).eqNullSafe("true").alias("oneway"), value("edge", "maxspeed").alias("maxspeed"))
    return nodes, edges


def write_network(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes.parquet")
    edges.write.mode("overwrite").parquet(f"{folder}/edges.parquet")


def network_hash(nodes: DataFrame, edges: DataFrame) -> str:
    """16 hex digits of what both tables hold, whatever the order of their rows and columns and the way they are stored."""
    parts = []
    for t in (nodes, edges):
        row = F.xxhash64(*sorted(t.columns))
        parts.append([sorted(t.columns), *map(str, t.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first())])
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:16]


def build_network(spark: SparkSession, graphml: str, folder: str, region: str, box: tuple[float, float, float, float] | None = None) -> dict:
    """A region's map from a GraphML road network: its tables, graph.graphml and meta.json; returns what meta.json says.

    box: (min lon, min lat, max lon, max lat); edges with both ends inside stay.
    """
    refuse_raw(folder)
    nodes, edges = read_graphml(spark, graphml)
    if box is not None:
        nodes = nodes.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
        for end in ("u", "v"):
            edges = edges.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi")
    write_network(nodes, edges, folder)
    nodes, edges = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("nodes", "edges"))
    meta = {"region": region, "bbox": box, "n_nodes": nodes.count(), "n_edges": edges.count(), "network_hash": network_hash(nodes, edges), "created_at": datetime.datetime.now(datetime.UTC).isoformat()}
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    source, target = path(graphml), path(f"{folder}/graph.graphml")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, True, conf)
    out = target.getFileSystem(conf).create(path(f"{folder}/meta.json"), True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    return meta


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A network from its tables, or from graph.graphml where they aren't there; its meta.json must be."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    has = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    if not has("meta.json"):
        raise FileNotFoundError(f"{folder}/meta.json is missing: build the map first")
    if has("nodes.parquet") and has("edges.parquet"):
        return spark.read.parquet(f"{folder}/nodes.parquet"), spark.read.parquet(f"{folder}/edges.parquet")
    return read_graphml(spark, f"{folder}/graph.graphml")


LOADERS: dict[str, Callable[..., DataFrame]] = {"geolife": read_plt}
