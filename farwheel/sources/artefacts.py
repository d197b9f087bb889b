"""Finished tables as artefacts: Parquet rows beside a manifest of kind, format, version, row count and digest.

A reader gives None where the manifest is absent, speaks of another kind or format, or doesn't fit the rows; rows that can't be
read at all raise. The digest is a sum over rows, so it needs no order and no task sees more than its own part."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "kind string, format int, version string, rows bigint, digest string"


def digest(rows: DataFrame) -> DataFrame:
    """One row (rows, digest): the count, and the sum of each row's first 60 bits of MD5 over its JSON, columns by name."""
    body = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(part.alias("p")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("p"), F.lit(0)).cast("string").alias("digest"))


def write(rows: DataFrame, path: str, kind: str, version: str, form: int = 1) -> None:
    """Rows first, then the manifest of what stands written: a writer that is lost halfway leaves no artefact."""
    rows.write.parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    head = digest(written).select(F.lit(kind).alias("kind"), F.lit(form).alias("format"), F.lit(version).alias("version"), "rows", "digest")
    head.write.json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read(spark: SparkSession, path: str, kind: str, forms: tuple[int, ...] = (1,)) -> DataFrame | None:
    head = manifest(spark, path)
    found = head.take(2) if head is not None else []  # one row a manifest
    if len(found) != 1 or found[0]["kind"] != kind or found[0]["format"] not in forms:
        return None
    rows = spark.read.parquet(f"{path}/rows")
    now = digest(rows).first()
    return rows if (now["rows"], now["digest"]) == (found[0]["rows"], found[0]["digest"]) else None


def write_lines(vertices: DataFrame, signatures: DataFrame, path: str, version: str) -> None:
    """Vertices (line, i, ...) with each line's one signature (line, signature); a line without one, or with several, is an error."""
    ones = signatures.groupBy("line").agg(F.min("signature").alias("signature"), F.count("*").alias("n"))
    bad = vertices.select("line").distinct().join(ones, "line", "left").where("n is null or n <> 1 or signature is null")
    if not bad.isEmpty():
        raise ValueError("every line needs one signature")
    write(vertices.join(ones.drop("n"), "line"), path, "lines", version, 2)


def read_lines(spark: SparkSession, path: str) -> DataFrame | None:
    return read(spark, path, "lines", (1, 2))


def write_walk_graph(nodes: DataFrame, edges: DataFrame, path: str, version: str) -> None:
    """A graph in canonical form: nodes (node, lat_e5, lon_e5), edges (edge, a, b, flags, name)."""
    write(nodes, f"{path}/nodes", "walk_nodes", version)
    write(edges, f"{path}/edges", "walk_edges", version)


def read_walk_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges), None too where an edge ends at no node."""
    nodes, edges = read(spark, f"{path}/nodes", "walk_nodes"), read(spark, f"{path}/edges", "walk_edges")
    if nodes is None or edges is None:
        return None
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return (nodes, edges) if ends.join(nodes, "node", "left_anti").isEmpty() else None
