"""OpenStreetMap extracts: JSON elements and OPL lines as way and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENT = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>, geometry array<struct<lat:double,lon:double>>"


def elements(answers: DataFrame) -> DataFrame:
    """All elements of (body): JSON answers with an `elements` list; the first of a type and id stays."""
    rows = answers.select(F.explode(F.from_json("body", f"elements array<struct<{ELEMENT.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")["elements"]).alias("e")).select("e.*")
    first = rows.withColumn("__i", F.monotonically_increasing_id()).groupBy("type", "id").agg(F.min_by(F.struct(*(rows[c] for c in rows.columns)), "__i").alias("e"))
    return first.select("e.*")


def ways(answers: DataFrame) -> DataFrame:
    return elements(answers).where((F.col("type") == "way") & (F.size("geometry") > 1)).select(F.col("id").alias("way_id"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), F.col("geometry").alias("points"))


def unescape(s: Column) -> Column:
    """`%hex%` stands for a character: the pieces between percent signs take turns, text and code."""
    parts = F.split(s, "%", -1)
    piece = lambda x, i: F.when(i % 2 == 0, x).otherwise(_char(x))
    return F.array_join(F.transform(parts, piece), "")


def _char(code: Column) -> Column:
    n = F.conv(code, 16, 10).cast("int")
    # UTF-8 of a code point, built from its bytes
    low = lambda shift: F.shiftright(n, shift).bitwiseAND(63) + 128
    two = F.concat(_hex(F.shiftright(n, 6) + 192), _hex(low(0)))
    three = F.concat(_hex(F.shiftright(n, 12) + 224), _hex(low(6)), _hex(low(0)))
    four = F.concat(_hex(F.shiftright(n, 18) + 240), _hex(low(12)), _hex(low(6)), _hex(low(0)))
    raw = F.when(n < 128, _hex(n)).when(n < 2048, two).when(n < 65536, three).otherwise(four)
    return F.decode(F.unhex(raw), "UTF-8")


def _hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def opl_ways(lines: DataFrame) -> DataFrame:
    """(way_id, tags, points) of OPL lines (line): ways whose nodes all carry a place."""
    f = F.split("line", " ")
    field = lambda c: F.get(F.transform(F.filter(f, lambda x: F.startswith(x, F.lit(c))), lambda x: F.substring(x, 2, 1 << 30)), 0)
    tags = F.transform(F.filter(F.split(F.coalesce(field("T"), F.lit("")), ","), lambda t: F.contains(t, F.lit("="))), lambda t: F.struct(unescape(F.substring_index(t, "=", 1)).alias("k"), unescape(F.substring_index(t, "=", -1)).alias("v")))
    node = F.transform(F.split(F.coalesce(field("N"), F.lit("")), ","), lambda n: F.struct(F.regexp_extract(n, r"x(-?[0-9.]+)", 1).try_cast("double").alias("lon"), F.regexp_extract(n, r"y(-?[0-9.]+)", 1).try_cast("double").alias("lat")))
    w = lines.where(F.startswith("line", F.lit("w"))).select(F.substring(F.get(f, 0), 2, 1 << 30).try_cast("bigint").alias("way_id"), F.map_from_entries(tags).alias("tags"), node.alias("n"))
    whole = w.where((F.size("n") > 1) & F.forall("n", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()))
    return whole.select("way_id", "tags", F.transform("n", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))
