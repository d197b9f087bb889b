"""Exact substring dedup: threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes covers it that also starts in a document of a smaller doc_id.

1. Every window of `length` bytes falls to its minimizer, the least hash among its K-byte strings; equal windows have
   equal minimizers. Runs of windows with one minimizer are the units. Minimizers are counted in packed blobs, one a hash
   part and stretch of documents; only runs whose minimizer two documents share go on, so what follows is as large as
   what repeats, not as the corpus.
2. The texts of these runs are dealt to blocks by minimizer and made distinct, each with its least doc_id. A block's
   Burrows-Wheeler transform, of its whole suffix order, is expanded breadth first: from the interval of the empty string,
   all intervals of one length are extended backward by every byte at once, which sets the common-prefix values in
   increasing order; at `length` the expansion stops, and suffixes between which no value was set share `length` bytes.
   Each such interval gets its least doc_id. Blocks that a frequent minimizer makes too large are dealt again by longer
   minimizers, up to whole windows, so that no transform outgrows a block however often a passage stands.
3. Every occurrence of a run looks its text up; windows whose least doc_id is smaller are repeats; spans are joined per
   document and cut.

Equal texts: those beyond the smallest doc_id go whole (from `length` bytes on), and a stretch of documents sends equal
texts on but once. Null texts are empty; shorter texts than `length` stay; a null doc_id takes no part and stays whole;
rows that repeat an id do not remove each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farwheel.llm.shared import beside, bitmap, in_bitmap, mix, partitions, prepare, settled, tables, written

#: Bytes of a minimizer, a multiple of 8: long enough that frequent words in a row seldom make one that two texts share.
K = 24
#: Bytes of text in one stretch of documents, in one transform, and in the largest before its texts are dealt again.
STRETCH, BLOCK, LARGEST = 8_000_000, 60_000, 240_000
_SEED = np.uint64(0x9E3779B97F4A7C15)


def eights(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    v = x.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    return v


def string_hashes(v: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all strings of k >= 8 bytes, of `eights`."""
    m = len(v) - k + 8
    seed = _SEED + np.uint64(k - K)
    h = v[:m] * seed
    for at in range(8, k, 8):
        at = min(at, k - 8)
        h = mix(h + mix(v[at : at + m] ^ seed))
    return h


def window_minima(x: np.ndarray, length: int, k: int = K) -> np.ndarray:
    """The minimizer's hash of each window of `length` bytes of `x` (uint8)."""
    n = len(x)
    if n < length:
        return np.zeros(0, np.uint64)
    h = string_hashes(eights(x), k)
    w, span = length - k + 1, 1
    while 2 * span <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


def runs_of(texts: list[bytes], length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, text's number, first window, windows) of all runs of the texts, in order."""
    out, lo = [], 0
    while lo < len(texts):  # a megabyte at a time
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1_000_000):
            size += len(texts[hi])
            hi += 1
        n = np.array([len(t) for t in texts[lo:hi]], np.int64)
        minima = window_minima(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), length, k)
        windows = np.maximum(n - length + 1, 0)
        starts = np.cumsum(n) - n
        of = np.repeat(np.arange(hi - lo), windows)
        first = np.cumsum(windows) - windows
        at = np.arange(len(of)) - first[of]
        m = minima[starts[of] + at]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1])
        b = np.flatnonzero(new)
        out.append((m[b], of[b] + lo, at[b], np.diff(np.append(b, len(m)))))
        lo = hi
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def interval_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, group of each): suffixes of one group share their first `length` symbols.

    `text`: symbols, 0 a separator. Groups hold for suffixes without a separator in their first `length` symbols."""
    n = len(text)
    symbols = int(text.max()) + 1
    # the whole suffix order: by 8 symbols, then doubled until all differ
    v = np.zeros(n + 8, np.uint64)
    v[:n] = text
    for step in (1, 2, 4):
        v[:-step] = (v[:-step] << np.uint64(8 * step)) | v[step:]
    order, rank = _ranked(v[:n])
    have = 8
    while rank[order[-1]] < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - have] = rank[have:] + 1
        order, rank = _ranked(rank * (n + 1) + later)
        have *= 2
    bwt = np.where(order > 0, text[order - 1], 0)
    kind = np.uint16 if n < 65536 else np.int32
    at = np.zeros((symbols, n + 1), kind)
    at[bwt, np.arange(1, n + 1)] = 1
    occ = np.ascontiguousarray(np.cumsum(at, axis=1, dtype=kind).T)  # of each symbol before each place
    counts = np.bincount(text, minlength=symbols)
    first = np.cumsum(counts) - counts
    apart = np.zeros(n + 1, bool)  # a common-prefix value under `length` is set here
    apart[0] = apart[n] = True
    lb, rb = np.array([0]), np.array([n])  # half open
    for _ in range(length):
        lows, highs = [], []
        for a in range(0, len(lb), 20_000):
            low = occ[lb[a : a + 20_000]]
            d = occ[rb[a : a + 20_000]] - low
            d[:, 0] = 0
            i, c = np.nonzero(d)
            start = first[c] + low[i, c]
            lows.append(start)
            highs.append(start + d[i, c])
        lo, hi = np.concatenate(lows), np.concatenate(highs)
        fresh = ~apart[hi]
        lb, rb = lo[fresh], hi[fresh]
        apart[rb] = True
        if not len(lb):
            break
    return order, np.cumsum(apart[:-1]) - 1


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in order of their keys, rank of each place); equal keys have one rank."""
    order = np.argsort(key)
    in_order = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
    return order, rank


def least_docs(texts: list[bytes], docs: np.ndarray, length: int, k: int = K) -> list[np.ndarray]:
    """For each text, the least doc of each of its windows over all texts, which fell together by minimizers of k bytes."""
    total = sum(map(len, texts)) + len(texts)
    if total > LARGEST:
        if k < length:
            return _dealt_again(texts, docs, length, k + (length - k + 1) // 2)
        least: dict[bytes, int] = {}  # all windows of a text are equal
        for t, d in zip(texts, docs.tolist(), strict=True):
            least[t[:length]] = min(least.get(t[:length], d), d)
        return [np.full(len(t) - length + 1, least[t[:length]]) for t in texts]
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    used = np.zeros(256, bool)
    used[raw] = True
    code = np.cumsum(used).astype(np.uint8)  # 256 symbols would need one more, but UTF-8 never uses all bytes
    text = code[raw]
    text[ends] = 0
    order, group = interval_groups(text, length)
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(texts)), windows)
    first = np.cumsum(windows) - windows
    at = starts[of] + np.arange(len(of)) - first[of]
    where = np.empty(len(text), np.int64)
    where[order] = group
    g = where[at]
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, g, docs[of])
    return np.split(least[g], np.cumsum(windows)[:-1])


def _dealt_again(texts: list[bytes], docs: np.ndarray, length: int, k: int) -> list[np.ndarray]:
    m, of, at, n = runs_of(texts, length, k)
    parts = -(-int((n + length).sum()) // (BLOCK // 2))
    part = (m >> np.uint64(16)) % np.uint64(parts)
    out = [np.zeros(len(t) - length + 1, np.int64) for t in texts]
    for p in np.unique(part):
        runs = np.flatnonzero(part == p)
        least: dict[bytes, int] = {}
        own = []
        for o, a, c in zip(of[runs].tolist(), at[runs].tolist(), n[runs].tolist(), strict=True):
            t = texts[o][a : a + c + length - 1]
            own.append((t, o, a))
            d = int(docs[o])
            if least.get(t, d) >= d:
                least[t] = d
        distinct = list(least)
        found = dict(zip(distinct, least_docs(distinct, np.array([least[t] for t in distinct], np.int64), length, k), strict=True))
        for t, o, a in own:
            out[o][a : a + len(found[t])] = found[t]
    return out


def may_share(texts: list[bytes], length: int) -> np.ndarray:
    """Whether each text, a run of windows with one minimizer, may have a window in common with another of its minimizer.

    A window is the minimizer and length - K bytes about it, so half of these at least stand on one side; texts can share
    one only if they agree on the half before the minimizer or on the half behind it. Where a minimizer stands twice in a
    text, all texts with it may share."""
    half = (length - K + 1) // 2
    sizes = np.array([len(t) for t in texts], np.int64)
    if half < 8:
        return np.ones(len(texts), bool)
    v = eights(np.frombuffer(b"".join(texts) + bytes(K + 8), np.uint8))
    h = string_hashes(v)
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes - K + 1)
    at = start[of] + np.arange(len(of)) - (np.cumsum(sizes - K + 1) - (sizes - K + 1))[of]
    least = np.minimum.reduceat(h[at], np.flatnonzero(np.append(True, of[1:] != of[:-1])))
    hit = np.flatnonzero(h[at] == least[of])
    own, first, times = np.unique(of[hit], return_index=True, return_counts=True)
    place = at[hit][first]  # of each text's minimizer; every text has one
    out = np.isin(least, least[own[times > 1]])
    for side, fits in ((place - half, place - half >= start), (place + K, place + K + half <= start + sizes)):
        i = np.flatnonzero(fits)
        key = mix(mix(v[side[i]] + least[i]) + v[side[i] + half - 8])
        _, same, n = np.unique(key, return_inverse=True, return_counts=True)
        out[i] |= n[same] > 1
    return out


# -- packed blobs -------------------------------------------------------------------------------------------------


def _split(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(part, kind="stable")
    keys, at = np.unique(part[order], return_index=True)
    for k, a, z in zip(keys.tolist(), at, [*at[1:], len(part)], strict=True):
        yield (k, *(x[order[a:z]] for x in arrays))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _ddl(names: list[str]) -> str:
    return "part int, " + ", ".join(f"{x} binary" for x in names[1:])


def _stretches(batches: Iterator[pa.RecordBatch], length: int, cols: int = 3) -> Iterator[list[list]]:
    """Columns of a stretch of documents (doc_id, h, text, ...), equal texts but once, with their smallest id."""
    held: dict[bytes, list] = {}
    size = 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t = row[2].encode("utf-8", "surrogatepass")
            if len(t) < length:
                continue
            was = held.get(t)
            if was is None or row[0] < was[0]:
                size += len(t) if was is None else 0
                held[t] = [row[0], row[1], t, *row[3:]]
            if size > STRETCH:
                yield [list(c) for c in zip(*held.values(), strict=True)]
                held, size = {}, 0
    if held:
        yield [list(c) for c in zip(*held.values(), strict=True)]


_U32 = np.uint64(0xFFFFFFFF)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(parts)


def _shared_runs(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(doc_id, h, runs): the numbers of a text's runs whose minimizer another text has too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _stretches(batches, length):
            m, of, _, _ = runs_of(texts, length)
            order = np.lexsort((of, m))
            m, of = m[order], of[order]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (of[1:] != of[:-1])
            u, n = np.unique(m[new], return_counts=True)
            many = np.packbits(n > 1)
            rows = [(k, (a & _U32).astype(np.uint32).tobytes(), np.packbits(c).tobytes()) for k, a, c in _split(_part(u, parts), u, np.unpackbits(many)[: len(u)])]
            yield _batch(rows, ["part", "x", "many"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        xs = [np.frombuffer(v, np.uint32) for v in table.column("x").to_pylist()]
        more = [np.unpackbits(np.frombuffer(v, np.uint8))[: len(x)] for v, x in zip(table.column("many").to_pylist(), xs, strict=True)]
        x = np.sort(np.concatenate([*xs, *(a[b > 0] for a, b in zip(xs, more, strict=True))]))
        u = np.unique(x[1:][x[1:] == x[:-1]])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "known": pa.array([u.tobytes()], pa.binary())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hs, texts in _stretches(batches, length):
            m, of, _, _ = runs_of(texts, length)
            first = np.searchsorted(of, np.arange(len(texts)))
            run = (np.arange(len(of)) - first[of]).astype(np.uint32)
            info = np.array([ids, hs], np.int64)
            rows = [(k, (a & _U32).astype(np.uint32).tobytes(), *_own(info, o), r.tobytes()) for k, a, o, r in _split(_part(m, parts), m, of, run)]
            yield _batch(rows, ["part", "x", "info", "o", "r"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(parts, ["part", "ids", "hs", "o", "a"])
        at_part, u = None, np.zeros(0, np.uint32)
        for b in batches:
            for part, known, x, o, r, info in zip(*(b.column(c).to_pylist() for c in ("part", "known", "x", "o", "r", "info")), strict=True):
                if known is not None:
                    at_part, u = part, np.frombuffer(known, np.uint32)
                elif part == at_part and len(u):
                    a = np.frombuffer(x, np.uint32)
                    hit = np.flatnonzero(u[np.minimum(np.searchsorted(u, a), len(u) - 1)] == a)
                    if len(hit):
                        out.add(np.frombuffer(info, np.int64).reshape(2, -1), np.frombuffer(o, np.uint32)[hit], np.frombuffer(r, np.uint32)[hit])
            yield from out.rows(GATHERED)
        yield from out.rows(1)

    def join(key: tuple, table: pa.Table) -> pa.Table:
        doc, h, (run,) = _homed(table, "a")
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, int)
        return pa.table({"doc_id": pa.array(doc[cut]), "h": pa.array(h[cut]), "runs": pa.array([np.sort(x).tobytes() for x in np.split(run, cut[1:])] if len(cut) else [], pa.binary())})

    known = docs.mapInArrow(count, _ddl(["part", "x", "many"])).groupBy("part").applyInArrow(add, "part int, known binary")
    dealt = docs.mapInArrow(deal, _ddl(["part", "x", "info", "o", "r"]))
    back = beside(known, dealt).mapInArrow(match, _ddl(["part", "ids", "hs", "o", "a"]))
    return back.groupBy("part").applyInArrow(join, "doc_id long, h long, runs binary")


def _own(info: np.ndarray, of: np.ndarray) -> tuple[bytes, bytes]:
    """The info of the documents that are used, and each item's number among them."""
    used, of = np.unique(of, return_inverse=True)
    return np.ascontiguousarray(info[:, used]).tobytes(), of.astype(np.uint32).tobytes()


def _home(info: np.ndarray, of: np.ndarray, parts: int, *arrays: np.ndarray) -> list[tuple]:
    """Blobs by the part of the document: its ids and hashes, and for each item the number among them and the arrays."""
    part = mix(info[0].view(np.uint64) + np.uint64(77)) % np.uint64(parts)
    out = []
    for k, o, *xs in _split(part[of], of, *arrays):
        used, o = np.unique(o, return_inverse=True)
        out.append((k, info[0][used].tobytes(), info[1][used].tobytes(), o.astype(np.uint32).tobytes(), *(x.tobytes() for x in xs)))
    return out


class _Sender:
    """Gathers items of many blobs before they are dealt by document, so that few rows leave a task."""

    def __init__(self, parts: int, names: list[str]) -> None:
        self.parts, self.names = parts, names
        self.held: list[tuple] = []
        self.docs = self.items = 0

    def add(self, info: np.ndarray, of: np.ndarray, *arrays: np.ndarray) -> None:
        self.held.append((info, of.astype(np.int64) + self.docs, *arrays))
        self.docs += info.shape[1]
        self.items += len(of)

    def rows(self, least: int) -> Iterator[pa.RecordBatch]:
        """What is held, if it is `least` items and more."""
        if self.held and self.items >= least:
            infos, ofs, *arrays = zip(*self.held, strict=True)
            yield _batch(_home(np.concatenate(infos, axis=1), np.concatenate(ofs), self.parts, *map(np.concatenate, arrays)), self.names)
            self.held, self.docs, self.items = [], 0, 0


#: Items that a task gathers before it sends them on.
GATHERED = 500_000


def _homed(table: pa.Table, *names: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one part: doc_id, h and the named arrays, sorted by document."""
    docs, hs, xs = [], [], [[] for _ in names]
    for row in zip(*(table.column(c).to_pylist() for c in ("ids", "hs", "o", *names)), strict=True):
        o = np.frombuffer(row[2], np.uint32)
        docs.append(np.frombuffer(row[0], np.int64)[o])
        hs.append(np.frombuffer(row[1], np.int64)[o])
        for x, v in zip(xs, row[3:], strict=True):
            x.append(np.frombuffer(v, np.uint32))
    doc, h = np.concatenate(docs), np.concatenate(hs)
    order = np.lexsort((h, doc))
    return doc[order], h[order], [np.concatenate(x)[order] for x in xs]


def _cut_runs(texts: list[bytes], wanted: list[bytes], length: int) -> tuple[np.ndarray, list[int], list[int], list[bytes]]:
    """(minimizer, text's number, first window, run's text) of the wanted runs."""
    m, of, at, n = runs_of(texts, length)
    first = np.searchsorted(of, np.arange(len(texts)))
    keep = np.concatenate([f + np.frombuffer(w, np.uint32).astype(np.int64) for f, w in zip(first, wanted, strict=True)])
    o, a, k = of[keep].tolist(), at[keep].tolist(), n[keep].tolist()
    return m[keep], o, a, [texts[i][j : j + c + length - 1] for i, j, c in zip(o, a, k, strict=True)]


def _spans(docs: DataFrame, length: int, parts: int, blocks: int) -> DataFrame:
    """(doc_id, h, spans): spans is binary, pairs of int64 [start, end) to remove, apart and in order.

    `docs`: doc_id, h, text, runs."""

    def deal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for ids, _, texts, runs in _stretches(batches, length):
            m, of, _, own = _cut_runs(texts, runs, length)
            block: dict[int, dict[bytes, list[int]]] = {}
            for b, x, o, t in zip(_part(m, blocks).tolist(), m.tolist(), of, own, strict=True):
                least = block.setdefault(b, {})
                if least.setdefault(t, [ids[o], x])[0] > ids[o]:
                    least[t][0] = ids[o]
            rows = [(b, pack(b"".join(d)), np.array([len(t) for t in d], np.uint32).tobytes(), np.array([v[0] for v in d.values()], np.int64).tobytes(), np.array([v[1] & 0xFFFFFFFF for v in d.values()], np.uint32).tobytes()) for b, d in block.items()]
            yield _batch(rows, ["part", "texts", "sizes", "docs", "minima"])

    def expand(key: tuple, table: pa.Table) -> pa.Table:
        least: dict[bytes, list[int]] = {}
        for texts, sizes, docs_, minima in zip(*(table.column(c).to_pylist() for c in ("texts", "sizes", "docs", "minima")), strict=True):
            raw, at = zstandard.ZstdDecompressor().decompress(texts), 0
            for n, d, x in zip(*(np.frombuffer(v, t).tolist() for v, t in ((sizes, np.uint32), (docs_, np.int64), (minima, np.uint32))), strict=True):
                t = raw[at : at + n]
                at += n
                if least.setdefault(t, [d, x])[0] > d:
                    least[t][0] = d
        distinct = list(least)
        docs_of = np.array([v[0] for v in least.values()], np.int64)
        # a text alone with its minimizer has no window in common with another
        _, of, n = np.unique(np.array([v[1] for v in least.values()], np.uint32), return_inverse=True, return_counts=True)
        mixed = np.flatnonzero((n[of] > 1) & may_share(distinct, length))
        found: dict[int, np.ndarray] = {}
        if len(mixed):
            mixed = mixed[np.argsort(of[mixed], kind="stable")]
            sizes = np.cumsum([len(distinct[i]) + 1 for i in mixed])
            lo = 0
            while lo < len(mixed):  # whole minimizers, about a block at a time
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + BLOCK, "right")))
                while hi < len(mixed) and of[mixed[hi]] == of[mixed[hi - 1]]:
                    hi += 1
                some = mixed[lo:hi]
                for i, x in zip(some.tolist(), least_docs([distinct[i] for i in some], docs_of[some], length), strict=True):
                    found[i] = x
                lo = hi
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        # each text's windows in stretches of one least document: (end, document)
        parts_of = {i: np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)) for i, x in found.items()}
        many = np.ones(len(distinct), np.int64)
        many[list(parts_of)] = [len(e) for e in parts_of.values()]
        order = np.argsort(keys)
        first = np.empty(len(distinct), np.int64)
        first[order] = np.cumsum(many[order]) - many[order]
        ends, docs_out = np.empty(many.sum(), np.uint32), np.empty(many.sum(), np.int64)
        ends[first] = np.array([len(t) for t in distinct], np.int64) - length + 1
        docs_out[first] = docs_of
        for i, e in parts_of.items():
            ends[first[i] : first[i] + len(e)] = e
            docs_out[first[i] : first[i] + len(e)] = found[i][e - 1]
        blobs = (keys[order], many[order].astype(np.uint32), ends, docs_out)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32())} | {k: pa.array([b.tobytes()], pa.binary()) for k, b in zip(("keys", "many", "ends", "docs"), blobs, strict=True)})

    def deal_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hs, texts, runs in _stretches(batches, length):
            m, of, at, own = _cut_runs(texts, runs, length)
            x = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
            info = np.array([ids, hs], np.int64)
            rows = [(k, a.tobytes(), *_own(info, o), p.tobytes()) for k, a, o, p in _split(_part(m, blocks), x, np.array(of, np.int64), np.array(at, np.uint32))]
            yield _batch(rows, ["part", "x", "info", "o", "p"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(parts, ["part", "ids", "hs", "o", "a", "b"])
        at_part = None
        for b in batches:
            for part, x, o, p, info, *known in zip(*(b.column(c).to_pylist() for c in ("part", "x", "o", "p", "info", "keys", "many", "ends", "docs")), strict=True):
                if known[0] is not None:
                    at_part = part
                    keys, m, end, least = (np.frombuffer(v, t) for v, t in zip(known, (np.uint64, np.uint32, np.uint32, np.int64), strict=True))
                    m, end = m.astype(np.int64), end.astype(np.int64)
                    base = np.cumsum(m) - m
                    continue
                if part != at_part:
                    continue
                k = np.searchsorted(keys, np.frombuffer(x, np.uint64))
                each = np.repeat(np.arange(len(k)), m[k])
                step = np.arange(len(each)) - np.repeat(np.cumsum(m[k]) - m[k], m[k])
                at = base[k][each] + step
                start = np.where(step > 0, end[at - 1], 0)
                info_ = np.frombuffer(info, np.int64).reshape(2, -1)
                of = np.frombuffer(o, np.uint32)[each]
                hit = np.flatnonzero(least[at] < info_[0][of])
                if len(hit):
                    place = np.frombuffer(p, np.uint32).astype(np.int64)[each]
                    out.add(info_, of[hit], (place + start)[hit].astype(np.uint32), (place + end[at] + length - 1)[hit].astype(np.uint32))
            yield from out.rows(GATHERED)
        yield from out.rows(1)

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        doc, h, (a, b) = _homed(table, "a", "b")
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, int)
        out = []
        for i, j in zip(cut, [*cut[1:], len(doc)], strict=True):
            s, e = a[i:j].astype(np.int64), b[i:j].astype(np.int64)
            order = np.argsort(s, kind="stable")
            s, e = s[order], np.maximum.accumulate(e[order])
            new = np.append(True, s[1:] > e[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
            out.append(np.stack([s[new], e[last]], 1).tobytes())
        return pa.table({"doc_id": pa.array(doc[cut]), "h": pa.array(h[cut]), "spans": pa.array(out, pa.binary())})

    names = ["part", "keys", "many", "ends", "docs"]
    found = docs.mapInArrow(deal_texts, _ddl(["part", "texts", "sizes", "docs", "minima"])).groupBy("part").applyInArrow(expand, _ddl(names))
    places = docs.mapInArrow(deal_places, _ddl(["part", "x", "info", "o", "p"]))
    back = beside(found, places).mapInArrow(look_up, _ddl(["part", "ids", "hs", "o", "a", "b"]))
    return back.groupBy("part").applyInArrow(unite, "doc_id long, h long, spans binary")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """`docs` (doc_id, text) as (doc_id, n_bytes, n_removed, n_spans, kept, spans): kept and spans are binary."""
    if length < K:
        raise ValueError(f"length must be at least {K}")
    spark = docs.sparkSession
    prepare(spark)
    since = tables(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text")
    long = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    # of equal texts all but the smallest id go whole
    same = long.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").cast("long").alias("n"))
    least = same.groupBy("h", "h2", "n").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = written(same.join(least.drop("most"), ["h", "h2", "n"]).where("doc_id > least").select("doc_id", "h").distinct(), "copies")
    doubt = in_bitmap("doc_id", bitmap(copies, "doc_id"))
    part = long.where(~doubt).unionByName(long.where(doubt).join(copies, ["doc_id", "h"], "left_anti").select("doc_id", "h", "text"))
    size = part.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), size // 20_000_000 + 1)
    shared = written(_shared_runs(part, length, parts), "runs", free=True)
    marks = bitmap(shared, "doc_id")
    joined = part.where(in_bitmap("doc_id", marks)).join(shared, ["doc_id", "h"]).select("doc_id", "h", "text", "runs")
    again = written(joined, "repeating", free=True)
    much = again.agg(F.sum(F.octet_length("runs"))).first()[0] or 0
    blocks = max(partitions(spark), much // 4 * 64 // 2_000_000 + 1)
    spans = _spans(again, length, parts, blocks)

    whole = copies.withColumn("whole", F.lit(True))
    gone = spans.join(whole, ["doc_id", "h"], "full").select("doc_id", "h", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    gone = settled(gone, "spans", since)
    return _apply(rows, gone)


def _apply(rows: DataFrame, gone: DataFrame) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans binary"

    def run(with_spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes, removed, many, kept, all_spans = [], [], [], [], []
                texts = b.column(1).to_pylist()
                spans = b.column(2).to_pylist() if with_spans else [None] * len(texts)
                whole = b.column(3).to_pylist() if with_spans else [False] * len(texts)
                for t, s, w in zip(texts, spans, whole, strict=True):
                    t = t.encode("utf-8", "surrogatepass")
                    if w:
                        s = np.array([0, len(t)], np.int64).tobytes()
                    at, out = 0, []
                    pairs = np.frombuffer(s, np.int64).reshape(-1, 2).tolist() if s else []
                    for x, y in pairs:
                        out.append(t[at:x])
                        at = y
                    out.append(t[at:])
                    kept.append(b"".join(out))
                    sizes.append(len(t))
                    removed.append(len(t) - len(kept[-1]))
                    many.append(len(pairs))
                    all_spans.append(s or b"")
                cols = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary()), pa.array(all_spans, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

        return cut

    marks = bitmap(gone, "doc_id")
    near = F.coalesce(in_bitmap("doc_id", marks), F.lit(False))
    hit = rows.where(near).join(gone, ["doc_id", "h"], "left").select("doc_id", "text", "spans", "whole")
    return hit.mapInArrow(run(True), schema).unionByName(rows.where(~near).select("doc_id", "text").mapInArrow(run(False), schema))
