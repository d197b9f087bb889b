"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents are tokenised on the executors and cut into pieces of at most `capacity` ids. Best-fit decreasing looks only
at lengths, so the driver plans it over the histogram of lengths (at most `capacity` rows whatever the corpus): pieces
of one length go, many at a time, to the open sequences with the tightest remaining capacity that holds them, which a
segment tree over capacities finds in log2(capacity) steps. The plan is a list of runs: the pieces of length L with ranks
r..r+n-1 go to sequences s..s+n-1 at one offset. The number of runs depends on the capacity, not on the corpus.
A piece's rank among those of its length is its rank within the task that wrote it plus the count of earlier tasks.

Null texts are empty; an empty text is the one end id; repeated rows and ties are packed as separate pieces; an empty
table gives no rows; a null doc_id is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.llm.shared import prepare, written

#: A place where two white spaces meet, or one at an end: there words can't be told apart by single spaces alone.
_ODD = re.compile(r"\s\s|\A\s|\s\Z")
_CACHE_WORDS = 250_000
_coders: dict[str, Coder] = {}


class Coder:
    """The ids of byte_bpe_50k: tiktoken over the same vocabulary, several times as fast as tokenizers.

    The vocabulary's pattern lets a single space between other characters begin a new part always, so a text falls into
    its space-separated words, whose ids are remembered. Other texts are encoded in one piece. The added tokens of the
    vocabulary's json, such as an end of text, are cut out first and have ids of their own. tests/llm compares all with
    tokenizers."""

    def __init__(self, ranks_path: str) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words: dict[str, bytes] = _Words(self)
        with open(ranks_path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.cut = re.compile("|".join(f"({re.escape(x)})" for x in sorted(added, key=len, reverse=True))) if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.cut and self.cut.search(text):
            parts = [p for p in self.cut.split(text) if p]
            return b"".join(self.added[p] if p in self.added else self.plain(p) for p in parts)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text or _ODD.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))


class _Words(dict):
    def __init__(self, coder: Coder) -> None:
        super().__init__()
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        ids = self.coder.whole(" " + word)
        if len(self) < _CACHE_WORDS and len(word) < 40:
            self[word] = ids
        return ids


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, capacity: int = 2048, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, rank): ids is binary, little-endian unsigned 32-bit.

    Only documents over `capacity` are cut; all their pieces but the first are full."""
    prepare(docs.sparkSession)
    path = ranks_path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = Coder(path)
        coder, task = _coders[path], TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = coder.ids(t or "") + end
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    length = (n - 1) % capacity + 1 if k == 0 else capacity
                    rows.append((d, k, start, length, ids[4 * start : 4 * (start + length)], seen[length]))
                    seen[length] += 1
                    start, k = start + length, k + 1
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(rows), pa.int32())], ["doc_id", "piece", "start", "length", "ids", "rank", "task"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary, rank long, task int")


class CapacityTree:
    """Counts of open sequences by remaining capacity; `tightest` finds the least capacity that has one and holds n."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.sums[i] += n
            i >>= 1

    def tightest(self, n: int) -> int | None:
        i = n + self.size
        if self.sums[i]:
            return n
        while i > 1:  # up until a right neighbour holds some, then down to its leftmost
            if i % 2 == 0 and self.sums[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset), and the number of sequences."""
    tree = CapacityTree(capacity)
    open_runs: dict[int, list[list[int]]] = {}  # remaining capacity -> [first sequence, how many]
    out, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            cap = tree.tightest(length)
            if cap is None:
                n = max(1, left // (capacity // length))  # sequences that this length will fill, or the last one
                open_runs.setdefault(capacity, []).append([sequences, n])
                tree.add(capacity, n)
                sequences += n
                cap = capacity
            stock = open_runs[cap]
            first, n = stock.pop()
            if n > left:
                stock.append([first + left, n - left])
                n = left
            out.append((length, rank, n, first, capacity - cap))
            tree.add(cap, -n)
            if cap > length:
                open_runs.setdefault(cap - length, []).append([first, n])
                tree.add(cap - length, n)
            rank, left = rank + n, left - n
    return out, sequences


def pack(docs: DataFrame, capacity: int = 2048, ranks_path: str | None = None, end_id: int = 0, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset, *carry): sequences without gaps from 0.

    `carry` names columns made from a piece's `ids`; by default it is `ids` itself. They are made before rows move, so a
    digest costs no shuffle of the ids."""
    spark = docs.sparkSession
    carry = {"ids": F.col("ids")} if carry is None else carry
    made = written(pieces(docs, capacity, ranks_path, end_id), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in made.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    table: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, first, offset in plan(counts, capacity)[0]:
        table.setdefault(length, []).append((rank, first, offset))
    places = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in table.items()})

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            t = places.value[int(n)]
            k = np.searchsorted(t[:, 0], ranks[at], "right") - 1
            seq[at] = t[k, 1] + ranks[at] - t[k, 0]
            off[at] = t[k, 2]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    narrow = made.select("doc_id", "piece", "start", "length", "task", "rank", *(c.alias(k) for k, c in carry.items()))
    ranked = narrow.join(base, ["length", "task"]).withColumn("__at", place("length", F.col("rank") + F.col("base")))
    return ranked.select("doc_id", "piece", "start", "length", "__at.sequence_id", "__at.offset", *carry)
