"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

An item of L k-word shingles is compared with windows of L shingles. Windows are those that hold at least one of the item's
shingles; others share nothing with it. A window's 64-bit SimHash, the signs of its summed hash bits, comes from
running sums over the text. The index cuts fingerprints into blocks of 16 bits, each with a table: key -> the items whose
own key lies within the block's radius. Radii sum to RADIUS - BLOCKS + 1, so fingerprints within RADIUS of each other are within
one block's radius at least (were all beyond, they would differ in RADIUS + 1 bits): a window's candidates, the union of
four look-ups, miss none. Pairs within RADIUS are verified by Jaccard similarity over shingles weighted by their multiplicities
alone: an item's matches depend on no other item, so neither repeated items nor the blocks of the benchmark change them.
At a similarity of 0.8 the expected distance is about 10 of 64 bits, and RADIUS leaves more than three deviations; tests/llm
measures what it finds of pairs at 0.8 and more.

The benchmark is sent to the executors in blocks of bounded size, each checked against all documents in one pass.

Words: all letters in lower case, ASCII punctuation as white space. Items and texts that are null or without words match
nothing; an item of fewer than k words is one shingle of all its words; a text shorter than an item is one window; a null
doc_id or item_id is reported as such; repeated rows each have their matches; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farwheel.llm.shared import prepare, shingle_hashes, word_hashes

RADIUS, BLOCKS = 20, 4
#: Of each block: they sum to RADIUS - BLOCKS + 1.
RADII = [(RADIUS - BLOCKS + 1 + b) // BLOCKS for b in range(BLOCKS)]
#: Of one block of the benchmark.
ITEMS, BYTES = 2000, 4_000_000
_PLAIN = bytes(32 if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None) -> np.ndarray:
    return word_hashes(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else [])


class Index:
    """The items of one block of a benchmark."""

    def __init__(self, items: list[tuple[int, str]], k: int, similarity: float) -> None:
        self.k, self.similarity = k, similarity
        self.ids: list[int] = []
        self.bags: list[Counter] = []
        self.sizes: list[int] = []
        self.ks: list[int] = []
        for item_id, text in items:
            w = words(text)
            if len(w):
                own = min(k, len(w))
                bag = Counter(shingle_hashes(w, own).tolist())
                self.ids.append(item_id)
                self.bags.append(bag)
                self.sizes.append(sum(bag.values()))
                self.ks.append(own)
        self.of: dict[int, list[int]] = {}
        for i, bag in enumerate(self.bags):
            for h in bag:
                self.of.setdefault(h, []).append(i)
        self.known = np.array(sorted(self.of), np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known & np.uint64(0xFFFF)] = True
        self.prints = np.array([self._print(b) for b in self.bags], np.uint64)
        self.tables = multi_index(self.prints)

    def _print(self, bag: Counter) -> int:
        h = np.array(list(bag), np.uint64)
        n = np.array(list(bag.values()))
        return int(_packed(((_bits(h) * 2.0 - 1) * n[:, None]).sum(0)[None, :])[0])

    def hits(self, h: np.ndarray) -> np.ndarray:
        """The places of shingles that some item holds."""
        at = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        if not len(at) or not len(self.known):
            return at[:0]
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        return at[self.known[k] == h[at]]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words), the best window of each item in the text."""
        w = words(text)
        out: dict[int, tuple[float, int, int]] = {}
        for k in set(self.ks):
            if len(w) < k:
                continue
            h = shingle_hashes(w, k)
            at = self.hits(h)
            if len(at):
                self._near(h, at, k, out)
        return [(self.ids[i], s, a, n) for i, (s, a, n) in sorted(out.items())]

    def _near(self, h: np.ndarray, at: np.ndarray, k: int, out: dict[int, tuple[float, int, int]]) -> None:
        where: dict[int, list[int]] = {}
        for p in at.tolist():
            for i in self.of[int(h[p])]:
                if self.ks[i] == k:
                    where.setdefault(i, []).append(p)
        by_size: dict[int, tuple[set[int], set[int]]] = {}
        for i, places in where.items():
            size = min(self.sizes[i], len(h))
            starts, items = by_size.setdefault(size, (set(), set()))
            items.add(i)
            for p in places:
                starts.update(range(max(0, p - size + 1), min(p, len(h) - size) + 1))
        lo = min(min(s) for s, _ in by_size.values())
        hi = max(max(s) + size for size, (s, _) in by_size.items())
        part = h[lo:hi]
        sums = np.zeros((len(part) + 1, 64))
        np.cumsum(_bits(part) * 2.0 - 1, axis=0, out=sums[1:])
        for size, (starts, items) in by_size.items():
            s = np.array(sorted(starts)) - lo
            prints = _packed(sums[s + size] - sums[s])
            for a, i in zip(*candidates(prints, self.prints, self.tables), strict=True):
                if i not in items:  # of another size, or with no shingle in common
                    continue
                i, start = int(i), int(s[a])
                x = self._similar(Counter(part[start : start + size].tolist()), self.bags[i])
                if x >= self.similarity and x > out.get(i, (0.0,))[0]:
                    out[i] = (x, start + lo, size + k - 1)

    @staticmethod
    def _similar(x: Counter, y: Counter) -> float:
        both = sum(min(n, y[h]) for h, n in x.items() if h in y)
        return both / (x.total() + y.total() - both)


def _near_keys(radius: int) -> np.ndarray:
    """All 16-bit numbers with at most so many bits."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= radius]


def multi_index(items: np.ndarray) -> list[np.ndarray]:
    """A table a block: for each key the items within the block's radius, as bits."""
    tables = []
    for b, radius in enumerate(RADII):
        keys = ((items >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
        table = np.zeros((1 << 16, -(-len(items) // 8)), np.uint8)
        near = _near_keys(radius)
        for i, key in enumerate(keys):
            table[near ^ key, i >> 3] |= np.uint8(1 << (i & 7))
        tables.append(table)
    return tables


def candidates(prints: np.ndarray, items: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (print, item) within RADIUS, through the tables."""
    found = []
    for lo in range(0, len(prints), 4096):
        own = prints[lo : lo + 4096]
        near = tables[0][own & np.uint64(0xFFFF)]
        for b in range(1, BLOCKS):
            near |= tables[b][(own >> np.uint64(16 * b)) & np.uint64(0xFFFF)]
        a, i = np.nonzero(np.unpackbits(near, axis=1, count=len(items), bitorder="little"))
        keep = np.bitwise_count(own[a] ^ items[i]) <= RADIUS
        found.append((a[keep] + lo, i[keep]))
    return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark, some items at a time: what is sent at once is bounded, whatever its size."""
    full = items.where("text is not null").select("item_id", "text")
    n, size = full.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // ITEMS), -(-(size or 0) // BYTES))
    for k in range(parts):
        yield [tuple(r) for r in full.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]


def find(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each item in each text."""
    spark = docs.sparkSession
    prepare(spark)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for block in _blocks(items):
        one = docs.select("doc_id", "text").mapInArrow(_finder(spark.sparkContext.broadcast(block), k, similarity), schema)
        out = one if out is None else out.unionByName(one)
    return out


_kept: dict[tuple, Index] = {}


def _index(name: str, block, k: int, similarity: float) -> Index:
    """The index of a block of the benchmark, made once a worker process; only the last one is kept."""
    key = (name, k, similarity)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Index(block.value, k, similarity)
    return _kept[key]


def _finder(block, k: int, similarity: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, block, k, similarity)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in index.matches(t)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def remove(docs: DataFrame, items: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` without the rows that hold an item; a pass a block of the benchmark, no shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index("text")
    for block in _blocks(items):
        docs = docs.mapInArrow(_remover(spark.sparkContext.broadcast(block), at, k, similarity), docs.schema)
    return docs


def _remover(block, at: int, k: int, similarity: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, block, k, similarity)
        for b in batches:
            yield b.filter(pa.array([not index.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return run
