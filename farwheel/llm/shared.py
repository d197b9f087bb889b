"""What the operators share: tables in the shared folder, word hashing, connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, by which all operators of this package split words.
SPACE = " \t\n\x0b\x0c\r"
#: Rows in one Arrow batch: a batch of whole texts must fit a worker's memory many times over.
BATCH_ROWS = 500
_M64 = (1 << 64) - 1
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where the session names none and all of Spark runs
    in one process, as in tests; a cluster without a shared folder is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="farwheel-")
        base = _own_dir[app]
    return base.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch where the session has left Spark's default of 10,000 rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) >= 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_written: dict[str, list[str]] = {}
_tables: dict[str, str] = {}


def written(df: DataFrame, name: str, free: bool = False, buckets: int = 0, key: str = "key") -> DataFrame:
    """`df` as a table in the shared folder: its lineage is cut, and a lost executor costs one task, not the plan.

    The tables of one application go when the driver ends. `free`: ask for the shuffle files behind it to go at once;
    Spark drops them when the driver's garbage is collected, which may else be much later. `buckets`: cut by hash of `key`
    into so many files, each sorted by it, so that joins of such tables need no shuffle."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write.option("compression", "zstd")
    if buckets:
        _tables[path] = "farwheel_" + path.rsplit("/", 1)[1].replace("-", "_")
        out.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_tables[path])
    else:
        out.parquet(path)
    if app not in _written:
        _written[app] = []
        atexit.register(_forget, spark, app)
    _written[app].append(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.table(_tables[path]) if buckets else spark.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession) -> int:
    """How many tables of this application stand."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """`df` as a table; the tables written since then, on which only it is built, go at once."""
    out = written(df, name, free=True)
    spark = df.sparkSession
    own = _written[spark.sparkContext.applicationId]
    for path in own[since:-1]:
        _delete(spark, path)
    del own[since:-1]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext._jsc is None:
            return
        for path in _written.pop(app, []):
            _delete(spark, path)
    except Exception:  # noqa: BLE001 the JVM may be gone at exit; nothing else is swallowed here
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


_hashes = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case: what bytes.split and bytes.lower do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; with fewer words the whole sequence as one, without words none."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out = mix(out + np.uint64(i + 1))
    return out


#: Bits of a bitmap of ids: a fixed size, whatever the data; full ones only stop sparing rows.
BITS = 1 << 20


def bitmap(rows: DataFrame, column: str) -> bytes:
    """128 KB in which the hashed values of `column` are set: at most 33 rows of 4 KB reach the driver."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS)) + 1
    chunks = rows.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    maps = {r[0]: bytes(r[1]) for r in chunks}
    return b"".join(maps.get(k, bytes(4096)) for k in range(1, BITS // 32768 + 1))


def in_bitmap(column: str, marks: bytes) -> Column:
    """False only for values that the bitmap doesn't hold; null for null."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int")
    byte = F.conv(F.hex(F.substring(F.lit(marks), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.col(column).isNotNull() & (F.getbit(byte, bit.bitwiseAND(7)) == 1)


def marked(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id may be in `ids`, the others): only the first need move to meet what belongs to an id."""
    near = F.coalesce(in_bitmap("doc_id", bitmap(ids, "doc_id")), F.lit(False))
    return docs.where(near), docs.where(~near)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` less the rows whose doc_id is in `ids`; rows of a null doc_id stay."""
    near, far = marked(docs, ids)
    return near.join(ids.hint("merge"), "doc_id", "left_anti").select(docs.columns).unionByName(far)


def beside(known: DataFrame, dealt: DataFrame) -> DataFrame:
    """The rows of both (part int, ...), by part, the `known` row of a part before its `dealt` ones, which then stream past it:
    what is known of a part travels once and no task holds a whole part. Columns that a row hasn't are null."""
    first, later = known.withColumn("__late", F.lit(0)), dealt.withColumn("__late", F.lit(1))
    both = first.unionByName(later, allowMissingColumns=True)
    return both.repartition("part").sortWithinPartitions("part", "__late").drop("__late")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in `edges` (a, b: of one type that has an order).

    Alternates large-star and small-star steps, each a shuffle of at most the edges, until nothing changes; a star
    needs two rounds, any graph O(log^2) of its size. Nothing is gathered on the driver but the changed count."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(both, "edges")
    state = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node gets its smallest neighbour (or itself)
        und = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = und.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = und.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself get the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now[0] == now[2] and tuple(now) == state or not now[0]:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    star = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
