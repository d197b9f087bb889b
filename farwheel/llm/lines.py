"""Line dedup: levelled sorted runs of line hashes.

`LineRuns` is the store. A run is a table of (key, n_docs, max_doc), cut into a fixed number of parts by hash of the key and
sorted by it within each. A new batch of documents merge-anti-joins all runs: the keys that none holds become a run of their
own, the others only add to the counts of keys seen before. When a level holds `fanout` runs, they are compacted
into one of the next level; runs share no key, so that is a merge. All tables are cut alike: the keys of a batch
are shuffled once, and neither the anti-joins nor the last join with the repeated keys move them again.

Keys: the line without ASCII white space at both ends, A-Z in lower case, as a 128-bit hash. Nulls and empty texts are
one empty line; a null doc_id takes no part and keeps its text; a line that repeats within a document counts once;
rows of one doc_id are one document, and what it loses goes from each of them; no ties arise, for doc_ids decide; extra columns
pass through `dedup_lines` untouched, but for those that have the names of its counts, which it replaces: ask for other names
where they must stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farwheel.llm.shared import SPACE, marked, partitions, prepare, settled, tables, written

_STRIP = SPACE.encode()


def _utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _long_enough(key: bytes, least: int) -> bool:
    """At least `least` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def _key(line: bytes, least: int) -> bytes | None:
    key = line.strip(_STRIP).lower()
    return xxhash.xxh3_128_digest(key) if _long_enough(key, least) else None


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, key): the distinct keys of at least `min_chars` code points of each document."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {_key(x, min_chars) for x in _utf8(t).split(b"\n")} - {None}
                ids += [d] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(keys, "doc_id long, key binary")


class LineRuns:
    """Levelled sorted runs of (key, n_docs, max_doc), and the counts of keys that later batches held again."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []

    def cut(self, keys: DataFrame) -> DataFrame:
        """(key, doc_id) as a table cut like the runs."""
        return written(keys.repartition(self.buckets, "key"), "line-keys", buckets=self.buckets)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows whose key no run holds."""
        out = rows
        for run in self.runs():
            out = out.join(run.select("key").hint("merge"), "key", "left_anti")
        return out.select(rows.columns)

    def add(self, keys: DataFrame) -> None:
        """Take in a batch's (key, doc_id), best `cut`: new keys become a run, known ones are counted."""
        own = keys.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        first = not self.runs()
        new = written(self.unseen(own), "run", buckets=self.buckets)
        if not first:
            self.again.append(written(own.join(new.select("key").hint("merge"), "key", "left_anti"), "seen"))
        self._put(0, new)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = written(_union(self.levels[level]).repartition(self.buckets, "key"), "run", buckets=self.buckets)
            self.levels[level] = []
            self._put(level + 1, merged)

    def repeated(self, min_docs: int) -> DataFrame:
        """(key, n_docs, max_doc) of the keys that at least `min_docs` documents hold."""
        if not self.runs():
            return self.spark.createDataFrame([], "key binary, n_docs long, max_doc long")
        if not self.again:
            return _union([r.where(F.col("n_docs") >= min_docs) for r in self.runs()])
        more = _union(self.again).groupBy("key").agg(F.sum("n_docs").alias("more"), F.max("max_doc").alias("later"))
        more = written(more, "seen", buckets=self.buckets)
        n, last = F.col("n_docs") + F.coalesce("more", F.lit(0)), F.greatest("max_doc", "later")
        return _union([r.join(more.hint("merge"), "key", "left").select("key", n.alias("n_docs"), last.alias("max_doc")).where(F.col("n_docs") >= min_docs) for r in self.runs()])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _batches(keys: DataFrame, n: int) -> list[DataFrame]:
    """(key, doc_id) in n ranges of doc_id, so that rows of one id stay together."""
    lo, hi = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return []
    cuts = [lo + (hi + 1 - lo) * i // n for i in range(n + 1)]
    return [keys.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """`docs` with `text` less its repeated lines, plus the counts of its lines and of the dropped ones (long), under `names`.

    A key found in at least `min_docs` documents loses all its lines except in the largest doc_id that holds it. Only the
    texts that lose a line move; a bitmap of fixed size tells most others."""
    spark = docs.sparkSession
    prepare(spark)
    since = tables(spark)
    runs = LineRuns(spark)
    keys = runs.cut(line_keys(docs, min_chars))
    for batch in _batches(keys, batches):
        runs.add(batch)
    repeated = written(runs.repeated(min_docs).select("key", "max_doc").repartition(runs.buckets, "key"), "repeated", buckets=runs.buckets)
    drops = keys.join(repeated.hint("merge"), "key").where("doc_id < max_doc")
    drops = settled(drops.groupBy("doc_id").agg(F.collect_set("key").alias("__drop")), "line-drops", since)

    rows = docs.select(*[c for c in docs.columns if c not in names])
    near, far = marked(rows, drops)
    near = near.join(drops.withColumnRenamed("doc_id", "__doc").hint("merge"), F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    joined = near.unionByName(far.withColumn("__drop", F.lit(None).cast("array<binary>")))
    at, drop_at = joined.columns.index("text"), joined.columns.index("__drop")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in joined.schema.fields if f.name != "__drop"]).add(names[0], "long").add(names[1], "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped = [], [], []
            for t, drop in zip(b.column(at).to_pylist(), b.column(drop_at).to_pylist(), strict=True):
                all_lines = _utf8(t).split(b"\n")
                stay, gone = all_lines, set(drop or ())
                if gone:
                    stay = [x for x in all_lines if _key(x, min_chars) not in gone]
                texts.append(b"\n".join(stay).decode("utf-8", "surrogatepass"))
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(stay))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns) if i != drop_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema.names)

    return joined.mapInArrow(cut, schema)
