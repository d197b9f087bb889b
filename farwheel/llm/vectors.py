"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors x fall, in each of `tables` tables, into the bucket of `width`-quantised projections
floor((a_i x + b_i) / width), a_i Gaussian (2-stable), i = 1..k. Two vectors at distance c share one projection's cell with
probability p(c) = 1 - 2 Phi(-w/c) - 2c (1 - exp(-w^2 / 2c^2)) / (sqrt(2 pi) w). k is the least that leaves a vector about
`crowd` unrelated ones (at distance sqrt 2) a bucket, the number of tables what then finds a pair exactly at the threshold
with probability `recall`; closer pairs are found more surely. Every pair that shares a bucket is compared by cosine in
double precision, in the first table that it shares only, so no pair counts twice.

Equal vectors are one with a weight. A bucket of more than `block` vectors is cut into blocks, and each pair of blocks is a
task of its own, so no task holds more than two blocks; tasks return sums and labels, not pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different length don't link;
a null id takes no part and has no component; rows that repeat an id and its vector are one vector, each with its row in the
result; different vectors under one id are vectors of their own, each with its links and component; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farwheel.llm.shared import components, mix, prepare, settled, tables, written

WIDTH = 2.0
_SIGN = -(1 << 63)


def cell_chance(distance: float, width: float = WIDTH) -> float:
    """The probability that one projection puts two points of this distance into one cell."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float, recall: float = 0.97, crowd: int = 64) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    k = max(2, math.ceil(math.log(max(n, 1) / crowd) / -math.log(cell_chance(math.sqrt(2))))) if n > crowd else 2
    return k, math.ceil(math.log(1 - recall) / math.log(1 - cell_chance(math.sqrt(2 - 2 * threshold)) ** k))


class Hashes:
    """Bucket keys of normalised vectors of one length; equal on all machines."""

    def __init__(self, dim: int, k: int, tables: int, seed: int = 20) -> None:
        rng = np.random.Generator(np.random.PCG64(seed + dim))
        self.a = rng.standard_normal((dim, tables * k))
        self.b = rng.uniform(0, WIDTH, tables * k)
        self.k, self.tables, self.dim = k, tables, dim

    def __call__(self, x: np.ndarray) -> np.ndarray:
        cells = np.floor((x @ self.a + self.b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), self.tables, self.k)
        key = np.zeros((len(x), self.tables), np.uint64) + np.uint64(self.dim) + np.arange(self.tables, dtype=np.uint64) * np.uint64(1 << 32)
        for i in range(self.k):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
        return key


def _labels(linked: np.ndarray) -> np.ndarray:
    """The least index that each row reaches in a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _node(vec_id: str, fp: str) -> Column:
    """A name for a class of equal vectors: its least id in 16 hex digits, in the order of ids, and half of its fingerprint, which
    tells apart the classes of one id."""
    return F.concat(F.lpad(F.hex(F.col(vec_id).bitwiseXOR(F.lit(_SIGN))), 16, "0"), F.substring(fp, 1, 16))


def _id_of(node: str) -> Column:
    return (F.conv(F.substring(node, 1, 16), 16, 10).cast("decimal(20,0)") + F.lit(_SIGN).cast("decimal(20,0)")).cast("long")


def links(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, crowd: int = 64, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id) of (vec_id, embedding)."""
    spark = vectors.sparkSession
    prepare(spark)
    since = tables(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    good = rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("e", lambda x: x + F.lit(0.0)).alias("e"))
    member = good.select("vec_id", F.md5(F.to_binary(F.array_join(F.transform("e", lambda x: x.cast("string")), ","), F.lit("utf-8"))).alias("fp"), "e")
    classes = written(member.groupBy("fp").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight"), F.first("e").alias("e")).withColumn("node", _node("rep", "fp")), "vectors")
    k, many = shape(classes.count(), threshold, recall, crowd)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for b in batches:
            es = b.column(1).to_pylist()
            keys = np.zeros((len(es), many), np.uint64)
            xs: list[bytes] = [b""] * len(es)
            dims = np.array([len(e) for e in es], np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.array([es[i] for i in at], np.float64)
                x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                if dim not in made:
                    made[dim] = Hashes(dim, k, many)
                keys[at] = made[dim](x)
                for i, v in zip(at, x, strict=True):
                    xs[i] = v.tobytes()
            out = pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), out, pa.array(xs, pa.binary())], ["node", "weight", "keys", "x"])

    known = written(classes.select("node", "e", "weight").mapInArrow(hashed, "node string, weight long, keys array<long>, x binary"), "hashed")
    cells = known.select("node", F.posexplode("keys").alias("t", "key"))
    full = cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # only shared buckets go on; what a vector needs of them is gathered, so that vectors move once
    places = cells.join(full, "key").groupBy("node").agg(F.collect_list(F.struct("t", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))).alias("places"))
    dealt = known.join(places, "node").select("node", "weight", "keys", "x", F.explode("places").alias("p"))
    own = F.pmod(F.xxhash64("node", "p.t"), F.col("p.blocks")).cast("int")
    dealt = dealt.select("node", "weight", "keys", "x", "p.t", "p.key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)).alias("other"))
    dealt = dealt.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "t", "key", "own", "node", "weight", "keys", "x")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        _, lo, hi, t = (x.as_py() for x in key)
        node = table.column("node")
        weight = table.column("weight").to_numpy()
        x = np.stack([np.frombuffer(v, np.float64) for v in table.column("x").to_pylist()])
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if lo != hi:  # pairs within a block are another task's
            own = table.column("own").to_numpy()
            linked &= own[:, None] != own[None, :]
        if t and linked.any():
            keys = np.array(table.column("keys").to_pylist(), np.int64)
            for earlier in range(t):
                linked &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
                if not linked.any():
                    break
        n = linked @ weight
        some = np.flatnonzero(n)
        label = _labels(linked)[some] if len(some) else some
        return pa.table({"node": node.take(pa.array(some)), "n": pa.array(n[some], pa.int64()), "to": node.take(pa.array(label))})

    found = written(dealt.groupBy("key", "lo", "hi", "t").applyInArrow(compare, "node string, n long, to string"), "found")
    comps = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    per = classes.select("fp", "node", "rep", "weight").join(counts, "node", "left").join(comps, "node", "left")
    per = per.select("fp", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce(_id_of("component"), "rep").alias("component_id"))
    ids = member.select("vec_id", "fp").join(per, "fp").select("vec_id", "n_links", "component_id")
    bad = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return settled(ids.unionByName(bad), "vector-links", since)
