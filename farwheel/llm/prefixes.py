"""Conversation prefix trie by sorted turn arrays.

Each conversation is the array of its turns' keys (128-bit hashes of role and text). All are range-sorted by (array, conv_id), so
the conversations that start alike stand together and a shorter one before those that go on. One sweep over a partition takes the
longest common prefix of neighbours: what is longer on the stack of open nodes closes, what the next array has more opens. A
closed node hands its counts to the one below it. The nodes on the paths of a partition's first and last arrays may go on in
other partitions and stay open: their counts so far are the partition's two open stacks, a row each, and one more sweep
over those rows, in order, closes them. A node's hash of ends is made as its ids pass in order; ids that stand at a
partition's edge are kept as chunks of `CHUNK` ids and hashed in order, so copies of one conversation may fill any number of
partitions.

A task holds the open stack, the closed nodes of which a parent is still open within the partition, and one row: a conversation's
keys, 16 bytes a turn. A row with null conv_id takes no part. Null role or text are empty; null turns come first; turns of one
number stand in the order of their keys; repeated rows are turns like others; very long texts only weigh as their hash; a
conversation without turns is a member of the root; an empty table has no root and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farwheel.llm.shared import partitions, prepare, settled, tables, written

CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"
#: A sweep's rows: kind 'node', 'stack' or 'ends'; a stack is its nodes from the root on.
_OPEN = "array<struct<path:binary,key:binary,words:long,n:long,least:long,children:long,leaves:long,saved:long,ends:string>>"
_ROWS = f"kind string, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, part long, i long, ids string, open {_OPEN}"
_NAMES = [x.split(" ")[0] for x in _ROWS.split(", ")]
_OPEN_TYPE = pa.list_(pa.struct([("path", pa.binary()), ("key", pa.binary()), *((x, pa.int64()) for x in ("words", "n", "least", "children", "leaves", "saved")), ("ends", pa.string())]))
_TYPES = [pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.int64(), pa.string(), _OPEN_TYPE]
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys array<binary>, words array<long>): the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", key.alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def shared_heads(own: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The same columns, rebuilt: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    head = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), *(F.slice(c, 1, most - 1).alias(f"__{c}") for c in ("keys", "words")))
    both = own.withColumn("__h", h).join(head, base == F.col("__base"), "left")
    return both.select("conv_id", *(F.concat(F.slice(F.coalesce(f"__{c}", F.array().cast(t)), F.lit(1), F.col("__h")), F.slice(c, F.col("__h") + 1, F.size(c) + 1)).alias(c) for c, t in (("keys", "array<binary>"), ("words", "array<long>"))))


class _Node:
    """An open node. `edge`: on the path of the partition's first array, so that it may have begun before."""

    __slots__ = ("key", "path", "words", "n", "least", "children", "leaves", "saved", "ends", "edge", "waiting")

    def __init__(self, key: bytes, path: bytes, words: int, edge: bool) -> None:
        self.key, self.path, self.words, self.edge = key, path, words, edge
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: str | None = EMPTY  # None: its ids stand in chunks
        self.waiting: list[dict] = []

    def member(self, conv: int | None, n: int = 1) -> None:
        self.n += n
        if conv is not None:
            self.least = conv if self.least is None else min(self.least, conv)

    def told(self) -> dict:
        return {"path": self.path, "key": self.key, "words": self.words, "n": self.n, "least": self.least, "children": self.children, "leaves": self.leaves, "saved": self.saved, "ends": self.ends}


def _closed(node: _Node, below: _Node | None, depth: int) -> Iterator[dict]:
    """The rows that can go when a node ends: its children's, which now know it. Its own waits with the one below, unless that one
    may go on in other partitions."""
    node.saved += (node.n - 1) * node.words
    node.leaves = node.leaves or 1
    row = {"kind": "node", "node": node.path, "conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.ends}
    for child in node.waiting:
        yield child | {"parent_conv_id": node.least}
    node.waiting = []
    if below is None:
        yield row
        return
    below.member(node.least, node.n)
    below.children += 1
    below.leaves += node.leaves
    below.saved += node.saved
    if below.edge:
        yield row | {"parent": below.path}
    else:
        below.waiting.append(row)


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _sweep(rows: Iterator[tuple[int, list[bytes], list[int]]], part: int) -> Iterator[dict]:
    """The closed nodes of one partition's (conv_id, keys, words), its open stacks and the ids of its edges or of many copies."""
    stack: list[_Node] = []
    first: list[bytes] = []
    last: list[bytes] | None = None
    early: list[dict] = []  # the closed part of the first array's path, deepest first
    run: list[bytes] = []  # ids of equal arrays in a row
    chunks, runs = 0, 0

    def chunk() -> dict:
        nonlocal chunks
        stack[-1].ends = None
        chunks += 1
        row = {"kind": "ends", "node": stack[-1].path, "part": part, "i": chunks, "ids": b",".join(run).decode()}
        run.clear()
        return row

    for conv, keys, words in rows:
        if last is None:
            first, stack = keys, [_Node(b"", b"", 0, True)]
        if keys != last:
            if run and (runs == 1 or stack[-1].ends is None):
                yield chunk()
            elif run:
                stack[-1].ends = hashlib.sha256(b",".join(run)).hexdigest()
                run.clear()
            same = _common(last or [], keys)
            while len(stack) > same + 1:
                node = stack.pop()
                if node.edge:
                    early.append(node.told())
                    for row in node.waiting:
                        yield row | {"parent": node.path}
                else:
                    yield from _closed(node, stack[-1], len(stack))
            for d in range(same, len(keys)):
                on = stack[-1].edge and d < len(first) and keys[d] == first[d]
                stack.append(_Node(keys[d], hashlib.md5(stack[-1].path + keys[d]).digest(), words[d], on))
            last, runs = keys, runs + 1
        stack[-1].member(conv)
        run.append(str(conv).encode())
        if len(run) >= CHUNK:
            yield chunk()
    if last is None:
        return
    if run:
        yield chunk()
    for node in stack:
        for row in node.waiting:
            yield row | {"parent": node.path}
    if early:
        under = [x.told() | {"n": 0, "least": None, "children": 0, "leaves": 0, "saved": 0, "ends": EMPTY} for x in stack[: len(first) + 1 - len(early)]]
        yield {"kind": "stack", "part": part, "i": 0, "open": under + early[::-1]}
    yield {"kind": "stack", "part": part, "i": 1, "open": [x.told() for x in stack]}


def _stitch(stacks: Iterator[list[dict]]) -> Iterator[dict]:
    """The nodes of the open stacks of all partitions in order."""
    stack: list[_Node] = []
    for told in stacks:
        same = 0
        while same < min(len(stack), len(told)) and stack[same].path == told[same]["path"]:
            same += 1
        while len(stack) > same:
            node = stack.pop()
            yield from _closed(node, stack[-1] if stack else None, len(stack))
        for x in told[same:]:
            stack.append(_Node(x["key"], x["path"], x["words"], False))
        for node, x in zip(stack, told, strict=True):
            node.member(x["least"], x["n"])
            node.children += x["children"]
            node.leaves += x["leaves"]
            node.saved += x["saved"]
            if x["ends"] != EMPTY:
                node.ends = x["ends"]
    while stack:
        node = stack.pop()
        yield from _closed(node, stack[-1] if stack else None, len(stack))


def _batched(rows: Iterator[dict], part: int, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append({"part": part} | row)
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def trie(arrays: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node, of (conv_id, keys, words).

    Nodes go by their smallest member. ends_sha256 hashes the decimal ids of the conversations that end there, ascending and
    comma-joined; saved_tokens is the sum over a node's subtree of (n_convs - 1) times the words of a node's own turn."""
    spark = arrays.sparkSession
    prepare(spark)
    since = tables(spark)
    own = written(arrays.select("conv_id", "keys", "words"), "turn-arrays")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batched(_sweep(rows, part), part)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_stitch(x for b in batches for x in b.column(0).to_pylist()), 0)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for path, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path != node:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = path, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["node", "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "sha"])

    ranged = own.repartitionByRange(parts or partitions(spark), "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    swept = written(ranged.mapInArrow(sweep, _ROWS), "trie-parts")
    stacks = swept.where("kind = 'stack'")
    joints = written(stacks.repartition(1).sortWithinPartitions("part", "i").select("open").mapInArrow(stitch, _ROWS), "trie-joints")
    chunks = swept.where("kind = 'ends'").repartition("node").sortWithinPartitions("node", "part", "i")
    ends = written(chunks.select("node", "ids").mapInArrow(hashed, "node binary, sha string"), "trie-ends")
    # a partition's rows meet the nodes of its own open paths, so the root's many children are dealt by partition
    paths = stacks.select("part", F.explode("open.path").alias("parent")).distinct()
    known = paths.join(joints.select(F.col("node").alias("parent"), F.col("conv_id").alias("__least")), "parent")
    inner = swept.where("kind = 'node'")
    lower = inner.where("parent is not null").join(known, ["part", "parent"], "left").withColumn("parent_conv_id", F.col("__least"))
    nodes = inner.where("parent is null").select("node", *_NODE).unionByName(lower.select("node", *_NODE)).unionByName(joints.select("node", *_NODE))
    long = nodes.where("ends_sha256 is null").join(ends, "node").withColumn("ends_sha256", F.col("sha")).select(_NODE)
    return settled(nodes.where("ends_sha256 is not null").select(_NODE).unionByName(long), "trie", since)
