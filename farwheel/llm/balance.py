"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

A document is its ids and an end id. Each task packs the documents that it reads, a batch of `windows` windows' ids at a time, so
nothing is shuffled and a task holds one batch and one document. A piece of `capacity` ids is a window by itself; cuts are free, so
the piece that would overfill a batch is cut there. `differencing` starts with a partial partition for each piece and always
merges the two of the largest imbalance, the heaviest windows of one with the lightest of the other, until one is left; where a
window exceeds the capacity, the count of windows rises and it starts anew. The windows then hold whole pieces and are near
equal. `level` closes what room they have left: the windows beyond the least count that the ids need are taken apart and
cut into the others' room. A batch's ids that fill no window go into windows of powers of two, which need no padding; only the last
batch of a task has such, at most log2(capacity) of them.

Null texts are empty; an empty text is the one end id; a null doc_id is kept; repeated rows and ties are packed as separate pieces;
very long texts are cut like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from farwheel.llm.shared import prepare

#: A document's or a piece's share: (its number, first id, ids).
Piece = tuple[int, int, int]
_CACHE = 800_000
_coders: dict[str, WordCoder] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCoder:
    """The ids of a BPE vocabulary with word ends whose words hold no white space, as `tokenizers` gives them.

    A text is the row of its parts between spaces and line ends, and a part's ids are remembered. Parts of the signs below
    `PLAIN` are lower-cased, cut into words and encoded by tiktoken, in which a line end stands for a word's end: merging it with a
    word's last byte comes first, then the vocabulary's own merges. All else is left to tokenizers."""

    PLAIN = 0x180

    def __init__(self, path: str) -> None:
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.own = Tokenizer.from_file(path)
        self.added = [x["content"] for x in spec["added_tokens"]]
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        of_byte = dict(zip(_visible(), range(256), strict=True))
        to_bytes = lambda s: bytes(of_byte[c] for c in s.removesuffix(end)) + (b"\n" if s.endswith(end) else b"")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 10]): 256 + b for b in range(256)}
        signs = {b: c for c, b in of_byte.items()}
        ids = [vocab[signs[b]] for b in range(256)] + [vocab[signs[b] + end] for b in range(256)]
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            ranks[to_bytes(a + b)] = len(ids)
            ids.append(vocab[a + b])
        self.ids_of = np.array(ids, "<u4")
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for s, r in ranks.items() if s.endswith(b"\n") and len(s) > 1]] = True
        self.encode = tiktoken.Encoding("word_bpe", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.odd = re.compile(f"[^\x00-{chr(self.PLAIN - 1)}]|" + "|".join(map(re.escape, self.added))).search
        self.known: dict[str, bytes] = {}

    def learn(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. The words of all plain ones are encoded at once; where a part's last word ends, its ids end."""
        if self.odd(" ".join(parts)):
            odd = [p for p in parts if self.odd(p)]
            theirs = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(odd, self.own.encode_batch(odd, add_special_tokens=False), strict=True)}
            rest = [p for p in parts if p not in theirs]
            theirs.update(zip(rest, self.learn(rest), strict=True) if rest else ())
            return [theirs[p] for p in parts]
        words: list[str] = []
        last = []
        for p in parts:
            if p.isascii():
                if p.isalpha():
                    words.append(p.lower())
                else:
                    words += self.words(p.lower())
            else:
                words += self.words(unicodedata.normalize("NFC", p).lower())
            last.append(len(words))
        if not words:
            return [b""] * len(parts)
        words.append("")
        ranks = np.array(self.encode("\n".join(words)), np.int64)
        ids = self.ids_of[ranks].tobytes()
        ends = (np.r_[0, np.flatnonzero(self.ends[ranks]) + 1] * 4)[last].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = text.replace("\n", " ").split(" ")
        got = list(map(self.known.get, parts))
        if None in got:
            new = list({p for p, g in zip(parts, got, strict=True) if g is None})
            fresh = dict(zip(new, self.learn(new), strict=True))
            if len(self.known) < _CACHE:
                self.known.update(fresh)
            got = [fresh[p] if g is None else g for p, g in zip(parts, got, strict=True)]
        return b"".join(got)


def _visible() -> list[str]:
    """The signs by which byte-level vocabularies write the bytes 0 to 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Numbers of `sizes` in at most k windows of near-equal sums.

    A partial partition is its windows, heaviest first, and those that aren't listed are empty. Merging puts the heaviest of one with
    the lightest of the other; only differences to the lightest window count from then on."""
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = max(0, len(a) + len(b) - k)  # the lightest of both that have no empty window to meet
        both = a[: len(a) - meet] + b[: len(b) - meet]
        both += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - meet :], reversed(b[len(b) - meet :]), strict=True)]
        both.sort(key=lambda w: -w[0])
        if len(both) == k:
            least = both[-1][0]
            both = [(n - least, w) for n, w in both]
        made += 1
        heapq.heappush(heap, (-(both[0][0] - (both[-1][0] if len(both) == k else 0)), made, both))
    return [_items(w) for _, w in heap[0][2]] if heap else []


def _items(tree: int | tuple) -> list[int]:
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, tuple):
            stack += t
        else:
            out.append(t)
    return out


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity` by differencing; their count rises whenever one exceeds it."""
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in windows)
        if not over:
            return windows
        k += max(1, over // capacity)


def level(windows: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """The same ids in windows of exactly `capacity`, the rest in powers of two: the lightest windows fill the others' room."""
    size = lambda w: sum(n for _, _, n in w)
    order = sorted(windows, key=size, reverse=True)
    total = sum(map(size, order))
    full, rest = divmod(total, capacity)
    out = [list(w) for w in order[:full]]
    loose = sorted((p for w in order[full:] for p in w), key=lambda p: p[2])
    rooms = [(capacity - size(w), w) for w in out]
    for bit in reversed(range(capacity.bit_length())):
        if rest >> bit & 1:
            out.append([])
            rooms.append((1 << bit, out[-1]))
    for room, w in rooms:
        while room:
            doc, start, n = loose.pop()
            take = min(n, room)
            w.append((doc, start, take))
            room -= take
            if take < n:
                loose.append((doc, start + take, n - take))
    return out


def pack(docs: DataFrame, capacity: int = 4096, windows: int = 128, path: str | None = None, end_id: int = 2) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of (doc_id, text); ids is binary, little-endian unsigned 32-bit."""
    prepare(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = WordCoder(path)
        coder, seq = _coders[path], TaskContext.get().partitionId() << 40
        held: dict[int, tuple[int | None, bytes]] = {}
        pool: list[Piece] = []
        filled, number = 0, 0

        def rows(packed: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            out: list[tuple] = []
            for w in packed:
                offset = 0
                for doc, start, n in w:
                    doc_id, ids = held[doc]
                    out.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, seq, offset))
                    offset += n
                seq += 1
            cols = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        def settle() -> Iterator[pa.RecordBatch]:
            yield from rows(level([[pool[i] for i in w] for w in near_equal([p[2] for p in pool], capacity)], capacity))

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = coder.ids(t or "") + end
                n, number, start = len(ids) // 4, number + 1, 0
                held[number] = (d, ids)
                whole = n // capacity * capacity
                if whole:
                    yield from rows([[(number, s, capacity)] for s in range(0, whole, capacity)])
                    start = whole
                while start < n:
                    take = min(n - start, windows * capacity - filled)
                    pool.append((number, start, take))
                    start, filled = start + take, filled + take
                    if filled == windows * capacity:
                        yield from settle()
                        pool, filled, held = [], 0, {number: held[number]}
                if not pool:
                    held = {}
        if pool:
            yield from settle()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
