"""Exact n-gram Jaccard join by a token-group matrix.

1. A text's set is its distinct k-word shingles as 64-bit hashes. Equal sets are one class, its smallest doc_id stands
   for it.
2. Two sets can link only if they share one of their first `n - ceil(t n) + 1` tokens in any one global order. The order
   is by document frequency, counted over all sets. Only a fixed share of the token space (a residue of the hash) is
   counted and stands first; it is wider than the prefixes, so a prefix lies in it but for few sets, which then add
   tokens of the rest by hash. Small sets are joined among themselves with all tokens counted.
   Tokens travel as packed blobs, one a hash part and batch; a token of a single set never becomes a row.
3. Every set of a token's posting meets the posting's hub, the set with most shared tokens: what links with the hub is one
   group, what doesn't stays by itself. Rooms are keyed by hub, so that a set travels once a hub, not once a token; two sets that
   share a prefix token share a room.
4. Within a room the sets by themselves are queries. Rows of the token-group matrix, the unions of the groups' tokens,
   bound a query's overlap with a group; only groups that reach ceil(t n) are opened and compared exactly. Rooms are cut into
   blocks of bounded tokens, a pair of blocks a task; tasks return links to one set of what they connect, never pairs.
5. Components over all links.

A null text, or one without words, has an empty set and links with nothing; fewer words than k make one shingle; a null
doc_id gets its n_shingles and no component; repeated rows are equal sets; of one doc_id with several texts each row has its
own set and component, and all are compared; ties in any order fall by hash; very long texts make large sets, which
are compared whole; an empty table gives no rows. 64-bit hashes stand for shingles and 128-bit ones for sets, whose first half
names a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.llm.shared import beside, bitmap, components, in_bitmap, partitions, prepare, settled, shingle_hashes, tables, without, word_hashes, words_of, written

#: Sets of at most so many tokens have all of them counted.
SMALL = 96
#: Tokens in one hash part, and in one block of a room.
PART_TOKENS, BLOCK_TOKENS = 2_000_000, 600_000


class Rule:
    """Links when den * intersection >= num * union, over k-word shingles."""

    def __init__(self, k: int, num: int, den: int) -> None:
        self.k, self.num, self.den = k, num, den
        self.share = max(2, int(1 / (1.5 * (1 - num / den)))) if num < den else 4  # one token in so many is counted

    def least(self, n: int) -> int:
        """The least overlap of a set of n tokens with any that it links with."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def tokens(self, text: str | None) -> np.ndarray:
        return np.unique(shingle_hashes(word_hashes(words_of(text)), self.k))


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, fp, cid, small, large, head): the tokens of a set are given once a task."""
    large_from = rule.least(SMALL + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = rule.tokens(t)
                n = len(s)
                fp = _print(s)
                small = large = None
                head = 0
                if n and fp not in told and d is not None:
                    told.add(fp)
                    if n <= SMALL:
                        small = s.tobytes()
                    if n >= large_from:
                        in_share = s % np.uint64(rule.share) == 0
                        first = s[in_share]
                        head = len(first)
                        more = max(0, rule.prefix(n) - head)
                        large = np.concatenate([first, s[~in_share][:more]]).tobytes()
                for c, v in zip(cols, (d, n, fp, _class(fp), small, large, head), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n", "fp", "cid", "small", "large", "head"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, fp binary, cid long, small binary, large binary, head long")


def _print(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _class(fp: bytes | None) -> int | None:
    return None if fp is None else int.from_bytes(fp[:8], "little", signed=True)


#: Tells the tokens of the two joins apart.
_LARGE = np.uint64(0xA0761D6478BD642F)


def _joins(n: int, small: bytes | None, large: bytes | None, head: int, rule: Rule) -> Iterator[tuple[int, np.ndarray, int]]:
    """(join, tokens, tokens in order before those of df 2 and more less the prefix) of one set."""
    if small is not None:
        yield 0, np.frombuffer(small, np.uint64), rule.prefix(n) - n
    if large is not None:
        yield 1, np.frombuffer(large, np.uint64) ^ _LARGE, rule.prefix(n) - head


def _shared_tokens(classes: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """(cid, join, n, room, rest, df, token): the tokens of df 2 and more."""
    p = np.uint64(parts)

    def split(x: np.ndarray, *with_x: np.ndarray) -> Iterator[tuple]:
        part = (x >> np.uint64(20)) % p
        order = np.argsort(part, kind="stable")
        keys, at = np.unique(part[order], return_index=True)
        for k, a, z in zip(keys.tolist(), at, [*at[1:], len(x)], strict=True):
            yield (k, *(y[order[a:z]] for y in (x, *with_x)))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Some sets at a time: (cid, join, n, room, head tokens, tokens)."""
        held, size = [], 0
        for b in batches:
            for cid, n, small, large, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for join, x, room in _joins(n, small, large, head, rule):
                    held.append((cid, join, n, room, head if join else n, x))
                    size += len(x)
                if size > PART_TOKENS:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            x, n = np.unique(np.concatenate([h[5] for h in held]), return_counts=True)
            rows = [(k, a.tobytes(), c.astype(np.uint32).tobytes()) for k, a, c in split(x, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "x", "c"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(v, np.uint64) for v in table.column("x").to_pylist()])
        c = np.concatenate([np.frombuffer(v, np.uint32) for v in table.column("c").to_pylist()])
        u, inv = np.unique(x, return_inverse=True)
        df = np.bincount(inv, c, len(u)).astype(np.int64)
        keep = df >= 2
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "known": pa.array([u[keep].tobytes()], pa.binary()), "dfs": pa.array([df[keep].tobytes()], pa.binary())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches):
            sizes = [len(h[5]) for h in held]
            x = np.concatenate([h[5] for h in held])
            of = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            within = np.concatenate([np.arange(s, dtype=np.int64) for s in sizes])
            rest = within >= np.repeat(np.array([h[4] for h in held], np.int64), sizes)  # past the counted share
            info = np.array([h[:4] for h in held], np.int64)
            rows = []
            for k, a, o, r in split(x, of, rest):
                used, o = np.unique(o, return_inverse=True)
                rows.append((k, a.tobytes(), o.astype(np.uint32).tobytes(), r.tobytes(), info[used].tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "x", "o", "r", "info"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "join", "n", "room", "rest", "df", "token"]
        at_part, u, df = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for part, known, dfs, x, o, r, info in zip(*(b.column(c).to_pylist() for c in ("part", "known", "dfs", "x", "o", "r", "info")), strict=True):
                if known is not None:
                    at_part, u, df = part, np.frombuffer(known, np.uint64), np.frombuffer(dfs, np.int64)
                elif part == at_part and len(u):
                    a = np.frombuffer(x, np.uint64)
                    at = np.minimum(np.searchsorted(u, a), len(u) - 1)
                    hit = np.flatnonzero(u[at] == a)
                    f = np.frombuffer(info, np.int64).reshape(-1, 4)[np.frombuffer(o, np.uint32)[hit]]
                    cols = [*(pa.array(np.ascontiguousarray(f[:, i])) for i in range(4)), pa.array(np.frombuffer(r, np.bool_)[hit]), pa.array(df[at[hit]]), pa.array(a[hit].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names)

    rows = classes.select("cid", "n", "small", "large", "head")
    counted = rows.mapInArrow(count, "part int, x binary, c binary")
    known = counted.groupBy("part").applyInArrow(add, "part int, known binary, dfs binary")
    dealt = rows.mapInArrow(deal, "part int, x binary, o binary, r binary, info binary")
    return beside(known, dealt).mapInArrow(match, "cid long, join long, n long, room long, rest boolean, df long, token long")


def _whole_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(cid, tokens) of the sets in `wanted` (cid, doc_id); a fixed-size bitmap spares other documents the shuffle."""
    near = docs.where("doc_id is not null").select("doc_id", "text")
    maybe = near.where(in_bitmap("doc_id", bitmap(wanted, "doc_id")))
    rows = maybe.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [rule.tokens(t) for t in b.column(1).to_pylist()]
            cids = [_class(_print(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "tokens"])

    made = rows.mapInArrow(run, "cid long, tokens binary").where("cid is not null")
    return made.groupBy("cid").agg(F.max("tokens").alias("tokens"))


def _with_hub(rooms: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(hub, cid, n, linked): every set of `rooms` (hub, cid, n) against its hub, which stands first in each block."""
    size = rooms.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    inside = rooms.where("cid <> hub").join(size, "hub").select("hub", "cid", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("late"))
    heads = size.select("hub", F.col("hub").alias("cid"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("late"))
    rows = inside.unionByName(heads).hint("merge").join(sets, "cid").select("hub", "cid", "block", "late", "tokens")

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for b in batches:
            out: list[tuple[int, int, int, bool]] = []
            for h, c, late, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                if not late:
                    hub = x
                    continue
                small, large = sorted((len(x), len(hub)))
                common = 0
                if rule.den * small >= rule.num * large:
                    both = np.sort(np.concatenate([x, hub]), kind="stable")
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append((h, c, len(x), rule.den * common >= rule.num * (small + large - common)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["hub", "cid", "n", "linked"])

    dealt = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "late")
    return dealt.mapInArrow(against, "hub long, cid long, n long, linked boolean")


def _in_rooms(told: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): what the sets that don't link with their hub connect, of `told` (hub, cid, n, linked)."""
    blocks = lambda tokens: F.ceil(F.coalesce(tokens, F.lit(0)) / BLOCK_TOKENS).cast("int")
    room = told.groupBy("hub").agg(
        blocks(F.sum(F.when(~F.col("linked"), F.col("n")))).alias("alone"), blocks(F.sum(F.when(F.col("linked"), F.col("n")))).alias("grouped"), F.count_if(~F.col("linked")).alias("many")
    )
    rows = told.join(room.where("many > 1 or many = 1 and grouped > 0"), "hub")
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("linked"), F.col("grouped")).otherwise(F.col("alone"))).cast("int")
    rows = rows.select("hub", "cid", "linked", "alone", "grouped", own.alias("own"))
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    o = F.col("own")
    with_groups = F.transform(up_to(F.col("grouped")), lambda q: pair(0, o, q))
    among = F.transform(up_to(F.col("alone")), lambda q: pair(1, F.least(o, q), F.greatest(o, q)))
    of_group = F.transform(up_to(F.col("alone")), lambda p: pair(0, p, o))
    dealt = rows.select("hub", "cid", "linked", "own", F.explode(F.when(F.col("linked"), of_group).otherwise(F.concat(with_groups, among))).alias("c"))
    dealt = dealt.select("hub", "cid", "linked", "own", "c.kind", "c.lo", "c.hi").hint("merge").join(sets, "cid")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        hub, kind, lo, hi = (x.as_py() for x in key)
        cid, linked, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "linked", "own"))
        a, b = room_links([np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("tokens")], linked.astype(bool), own if lo != hi else None, rule, kind == 0)
        return pa.table({"a": pa.array(cid[a], pa.int64()), "b": pa.array(cid[b] if kind else np.full(len(a), hub), pa.int64())})

    return dealt.groupBy("hub", "kind", "lo", "hi").applyInArrow(compare, "a long, b long")


def room_links(sets: list[np.ndarray], linked: np.ndarray, own: np.ndarray | None, rule: Rule, to_group: bool) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), places of sets that link. `to_group`: of each set not `linked` one link at most with the group of those that are;
    otherwise what the sets not linked connect among themselves, each with the least place of its component. `own`: only
    sets of different blocks are compared."""
    none = np.zeros(0, np.int64)
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    need = -(-rule.num * n // rule.den)
    col = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(m), n)
    alive = np.ones(m, bool)
    while True:  # a set with too few tokens that others here have can't link; it goes, until none does
        df = np.bincount(col[alive[row]], minlength=1)
        held = np.bincount(row, alive[row] & (df[np.minimum(col, len(df) - 1)] > 1), m)
        keep = alive & (held >= need)
        if keep.sum() == alive.sum():
            break
        alive = keep
    target = alive & linked if to_group else alive
    ask = np.flatnonzero(alive & ~linked)
    if not len(ask) or not target.any():
        return none, none
    width = int(col.max()) + 1
    if to_group:  # the group's row of the matrix: the union of its tokens
        union = np.zeros(width, bool)
        union[col[target[row]]] = True
        ask = ask[np.bincount(row, union[col], m)[ask] >= need[ask]]
    of_target = target[row]
    order = np.argsort(col[of_target], kind="stable")
    holder = row[of_target][order]
    start = np.searchsorted(col[of_target][order], np.arange(width + 1))
    first = np.cumsum(n) - n
    label = np.arange(m)
    to: list[tuple[int, int]] = []
    for a in ask.tolist():
        t = col[first[a] : first[a] + n[a]]
        many = start[t + 1] - start[t]
        places = np.repeat(start[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(holder[places], minlength=m)
        ok = target & (rule.den * common >= rule.num * (n[a] + n - common))
        ok[a] = False
        if own is not None and not to_group:
            ok &= own != own[a]
        hit = np.flatnonzero(ok)
        if not len(hit):
            continue
        if to_group:
            to.append((a, int(hit[0])))
        else:
            joined = np.unique(label[np.append(hit, a)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    if to_group:
        return (np.array([x for x, _ in to], np.int64), np.array([y for _, y in to], np.int64)) if to else (none, none)
    moved = np.flatnonzero(label != np.arange(m))
    return moved, label[moved]


def components_of(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of `docs` (doc_id, text); component_id is the smallest doc_id reachable."""
    spark = docs.sparkSession
    prepare(spark)
    rule, since = Rule(k, num, den), tables(spark)
    made = written(_sets(docs, rule), "sets")
    known = made.where("doc_id is not null and fp is not null")
    classes = written(
        known.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("cid").alias("cid"), F.max("n").alias("n"), F.max("small").alias("small"), F.max("large").alias("large"), F.max("head").alias("head")),
        "classes",
    )
    tokens = classes.agg(F.sum(F.coalesce(F.octet_length("small"), F.lit(0)) + F.coalesce(F.octet_length("large"), F.lit(0)))).first()[0] or 0
    parts = max(partitions(spark), tokens // 8 // PART_TOKENS + 1)
    shared = _shared_tokens(classes, rule, parts)

    # prefixes: of a set's tokens in order, those of df 1 stand first and need no row
    item = F.struct("rest", "df", "token")
    per = shared.groupBy("cid", "join", "n", "room").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count_if(~F.col("rest")).alias("counted"))
    take = F.greatest(F.lit(0), F.col("room") + F.col("counted")).cast("int")
    per = per.withColumn("items", F.slice("items", F.lit(1), take)).where(F.size("items") > 0)
    postings = written(per.select("cid", "n", (F.col("counted") / F.col("n")).alias("held"), F.explode("items.token").alias("token")), "postings")

    hubs = postings.groupBy("token").agg(F.max(F.struct("held", "cid")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("token", F.col("hub.cid").alias("hub"))
    rooms = written(postings.join(hubs, "token").select("hub", "cid", "n").distinct(), "rooms")
    # joins with sets and texts are merges at every size, so that cost grows as the input does
    wanted = rooms.select("cid").distinct().join(classes.select("cid", "doc_id"), "cid")
    sets = written(_whole_sets(docs, written(wanted, "wanted"), rule), "whole")
    told = written(_with_hub(rooms, sets, rule), "told")
    links = told.where("linked").select(F.col("cid").alias("a"), F.col("hub").alias("b")).unionByName(_in_rooms(told, sets, rule))
    final = components(written(links, "links"))

    least = final.join(classes.select("cid", "doc_id"), F.col("node") == F.col("cid")).groupBy("component").agg(F.min("doc_id").alias("least"))
    named = final.join(least, "component").select("node", "least")
    home = classes.join(named, F.col("cid") == F.col("node"), "left").select("fp", F.coalesce("least", "doc_id").alias("component_id"))
    out = made.select("doc_id", "n", "fp").join(home.hint("merge"), "fp", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return settled(out, "jaccard", since)


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with the smallest doc_id of each component; rows of a null doc_id stay, rows of one doc_id go together.

    Ids move, and of the texts about those that go."""
    gone = components_of(docs, k, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, written(gone, "gone"))
