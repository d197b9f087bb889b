"""Balanced packing, the prefix trie and whitening against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from farwheel.llm import balance, prefixes, queries, whitening
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"

# -- balanced packing --


def test_word_coder_equals_tokenizers():
    import json

    from tokenizers import Tokenizer

    path = balance.tokenizer_path()
    own, theirs, rng = balance.WordCoder(path), Tokenizer.from_file(path), random.Random(1)
    signs = [chr(i) for i in range(1, 0x260)] + ["'s", "'ll", " ", "\n", "\t", "ab", "the", "<|endoftext|>", "<|startoftext|>", "Σ", "ς", "ΑΣ", "漢", "\U0001f600", "é", "́", "\x1c", "\x85", "\xa0", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñß") for _ in range(rng.randint(1, 14))) for _ in range(20000)]
    of_byte = dict(zip(balance._visible(), range(256), strict=True))
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    texts += [bytes(of_byte[c] for c in s.removesuffix("</w>")).decode("utf-8", "ignore") for s in vocab]
    texts += [" ".join(texts[:500]), "a" * 5000, "", "x " * 3000]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want.ids, text


def plain_differencing(sizes, k):
    """Every partial partition as k sums; the two of the largest difference merge, heaviest with lightest."""
    parts = [[n] + [0] * (k - 1) for n in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda s: s[-1] - s[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


def test_differencing():
    rng = random.Random(2)
    assert sorted(sum(w) for w in [[[8, 7, 6, 5, 4][i] for i in w] for w in balance.differencing([8, 7, 6, 5, 4], 2)]) == [14, 16]
    for _ in range(60):
        sizes, k = rng.sample(range(1, 10**6), rng.randint(1, 40)), rng.randint(1, 9)
        got = balance.differencing(sizes, k)
        assert sorted(i for w in got for i in w) == list(range(len(sizes))) and len(got) <= k
        sums = sorted(sum(sizes[i] for i in w) for w in got)
        want = sorted(plain_differencing(sizes, k))
        assert [0] * (k - len(sums)) + sums == want
    assert balance.differencing([], 3) == []


def test_count_rises_and_level():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))]
        windows = balance.near_equal(sizes, 64)
        assert max(sum(sizes[i] for i in w) for w in windows) <= 64
        assert balance.near_equal([60, 60, 60], 64) and len(balance.near_equal([33, 33, 33], 64)) == 3  # two would hold their sum
        got = balance.level([[(i, 0, sizes[i]) for i in w] for w in windows], 64)
        held = [sum(n for _, _, n in w) for w in got]
        full, rest = divmod(sum(sizes), 64)
        assert sorted(held, reverse=True) == [64] * full + [1 << b for b in reversed(range(7)) if rest >> b & 1]
        places = sorted((i, s, n) for w in got for i, s, n in w)
        for i, size in enumerate(sizes):
            own = [(s, n) for j, s, n in places if j == i]
            assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == size


@pytest.mark.parametrize("windows", [1, 3, 128])
def test_pack_windows(spark, windows):
    from tokenizers import Tokenizer

    theirs, rng = Tokenizer.from_file(balance.tokenizer_path()), random.Random(4)
    texts = [(i, " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "long " * 2000), (63, "  \n "), (None, "no id"), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("length", F.lit(1)).repartition(3)
    got = balance.pack(docs, capacity=64, windows=windows).toPandas()
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        n = s.length.sum()
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and (n == 64 or n & (n - 1) == 0) and n <= 64
    assert (got.ids.map(len) == 4 * got.length).all()
    short = got.groupby("sequence_id").length.sum()
    assert (short < 64).sum() <= 3 * 6  # some powers of two a task
    for d, t in texts:
        if d not in (5, None):
            own = got[got.doc_id == d].sort_values("start")
            ids = theirs.encode(t or "", add_special_tokens=False).ids + [2]
            assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == ids and own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
            assert (own.doc_tokens == len(ids)).all()
    assert got[got.doc_id.isna()].length.sum() == len(theirs.encode("no id").ids) + 1
    assert balance.pack(docs.limit(0)).count() == 0


# -- the prefix trie --


def brute_trie(turns, every=20, most=4):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest(), (r or "", x or "")))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = own.get(c - c % every, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = sum(not any(len(y) == len(m) + 1 and y[: len(m)] == m for y in below) for m in below)
        words = lambda m: len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0
        saved = sum((len(members[m]) - 1) * words(m) for m in below)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats(seed, n=70, copies=25):
    rng = random.Random(seed)
    heads = [("system", "be kind  to all"), ("user", "hi"), (None, None)]
    out = []
    for c in rng.sample(range(400), n):
        for t in range(rng.randint(1, 6)):
            r, x = rng.choice(heads) if rng.random() < 0.7 else ("user", f"w {rng.randint(0, 5)}")
            out.append((c, None if rng.random() < 0.1 else t, r, x))
    for c in range(1000, 1000 + copies):  # one conversation many times; their base 1000 and others too
        out += [(c, t, "user", f"copy {t}") for t in range(3)]
    return out + [(None, 0, "user", "x"), (21, 0, "user", "alone"), (41, 0, "a", "b"), (41, 0, "a", "b"), (2000, 0, "user", "y" * 20000)]


@pytest.mark.parametrize("parts", [1, 2, 7, 40, 200])
def test_trie(spark, parts):
    turns = chats(parts)
    rows_ = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("keys", F.lit(1)).withColumn("h", F.lit("x"))
    got = prefixes.trie(prefixes.shared_heads(prefixes.ordered(rows_)), parts=parts).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(turns)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_sweep_and_stitch_of_any_cut(monkeypatch, chunk):
    """Sweeps over all cuts of one sorted list give one trie; empty parts don't matter."""
    monkeypatch.setattr(prefixes, "CHUNK", chunk)
    rng = random.Random(9)
    data = sorted((([bytes([rng.randint(0, 2)]) for _ in range(rng.randint(0, 3))]), c) for c in range(60))
    want = None
    for _ in range(60):
        cuts = sorted(rng.choices(range(61), k=rng.randint(0, 9)))
        out = []
        for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True)):
            out += [{"part": p} | r for r in prefixes._sweep(((c, k, [1] * len(k)) for k, c in data[a:b]), p)]
        joints = list(prefixes._stitch(r["open"] for r in sorted((r for r in out if r["kind"] == "stack"), key=lambda r: (r["part"], r["i"]))))
        ids = defaultdict(list)
        for r in sorted((r for r in out if r["kind"] == "ends"), key=lambda r: (r["part"], r["i"])):
            ids[r["node"]].append(r["ids"])
        least = {r["node"]: r["conv_id"] for r in joints}
        nodes = []
        for r in [*joints, *(r for r in out if r["kind"] == "node")]:
            sha = r["ends_sha256"] or hashlib.sha256(",".join(ids[r["node"]]).encode()).hexdigest()
            nodes.append((r["conv_id"], r["depth"], least[r["parent"]] if "parent" in r else r.get("parent_conv_id"), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], sha))
        nodes.sort(key=str)
        want = want or nodes
        assert nodes == want


def test_empty_trie(spark):
    assert prefixes.trie(prefixes.ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_trie_query(spark):
    name = "op12_conversation_prefix_trie"
    got, want = queries.QUERIES[name](spark, SF).toPandas(), connect(SF).execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# -- whitening --


def test_residues():
    for bound in (1, 10**9, 10**40):
        moduli = whitening.primes(bound)
        assert np.prod([float(p) for p in moduli]) > 2 * bound and all(p < 1 << 20 for p in moduli) and len(set(moduli)) == len(moduli)
        values = [0, 1, -1, bound, -bound, bound // 3]
        residues = np.array([[v % p for v in values] for p in moduli])
        assert whitening.reconstruct(residues, moduli) == values


def vectors(n=300, dim=6, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) @ np.diag([5, 3, 2, 1, 0.5, 0.2][:dim]) + 1
    out = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    out += [(1000 + i, out[0][1]) for i in range(50)] + [(7, out[7][1]), (None, out[3][1])]
    return out + [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2003, [float("nan")] * dim), (2004, [float("inf")] + [0.0] * (dim - 1)), (2005, [-0.0] * dim)]


def test_whitening(spark):
    data = vectors()
    docs = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("n", F.lit(1)).repartition(5)
    got = whitening.whiten(docs).toPandas()
    good = [(i, [int(np.floor(256 * v)) for v in e]) for i, e in data if e and all(v is not None and np.isfinite(v) for v in e)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.array([[float(sum(Fraction(n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit) / n**3) for j in range(6)] for i in range(6)])
    e, u = np.linalg.eigh(v)
    assert len(got) == 4 * len(good) and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for k in range(4):
        own = got[got.component == k + 1]
        assert np.allclose(own.explained, e[-1 - k] / np.trace(v), rtol=1e-12)
        want = {i: sum((x[j] - s[j] / n) * u[j, -1 - k] for j in range(6)) / e[-1 - k] ** 0.5 for i, x in good}
        pairs = np.array([(w, want[None if i != i else int(i)]) for i, w in zip(own.vec_id, own.whitened, strict=True)])
        assert min(abs(pairs[:, 0] - pairs[:, 1]).max(), abs(pairs[:, 0] + pairs[:, 1]).max()) < 1e-9
    for i, x in good:
        far = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert set(got[got.vec_id.isna() if i is None else got.vec_id == i].deviation) == {far}


def test_scatter_is_exact_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(-(10**15), 10**15, size=(50, 3))
    fit = spark.createDataFrame([(list(map(int, r)),) for r in x], "x array<long>").repartition(4)
    monkeypatch.setattr(whitening, "BLOCK", 3)
    known = whitening.sums(fit)
    v = whitening.scatter(fit, known)[3]
    n, s = 50, [int(c) for c in x.astype(object).sum(0)]
    assert known[3] == (50, int(np.abs(x).max()), s)
    for i in range(3):
        for j in range(3):
            assert v[i, j] == float(Fraction(sum((n * int(r[i]) - s[i]) * (n * int(r[j]) - s[j]) for r in x), n**3))


def test_whitening_odd(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind))
    assert one.count() == 0  # one distinct vector has no spread
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, 2.0 * i]) for i in range(9)], kind)).toPandas()
    assert set(flat.component) == {1} and abs(flat.explained.iloc[0] - 1) < 1e-12
    mixed = whitening.whiten(spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(9)] + [(10 + i, [float(i)]) for i in range(4)], kind)).toPandas()
    assert mixed.groupby("n").component.max().to_dict() == {9: 2, 4: 1}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])], kind)).toPandas()
    assert set(huge[huge.vec_id == 3].deviation) == {1 + (3 * 768 - 1024) ** 2} and huge[huge.vec_id < 3].deviation.isna().all()
