"""Each operator on a few rows against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from farwheel.llm import contamination, jaccard, langid, licences, lines, packing, pages, pii, repeats, shared, vectors

ODD = [(90, None), (91, ""), (92, "   "), (93, "a"), (94, "Ünïcode é\u0000x"), (95, "a" * 3000)]


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, words(rng, rng.randint(3, 120), vocab)) for i in range(40)]
    for i in range(40, 60):  # near copies of one text, and chains of them
        w = rows[i % 4][1].split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(50)
        rows.append((i, " ".join(w)))
    rows += [(60, rows[5][1]), (61, rows[5][1].upper()), (62, rows[6][1] + "\n" + rows[7][1])]
    return rows + ODD


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("n", F.lit(1)).withColumn("key", F.lit("x")).withColumn("h", F.lit(2)) if extra else df


# -- packing --


def test_tree_is_tightest():
    rng = random.Random(3)
    tree, open_ = packing.CapacityTree(50), Counter()
    for _ in range(400):
        c = rng.randint(0, 50)
        tree.add(c, 1)
        open_[c] += 1
        n = rng.randint(1, 50)
        want = min((c for c, k in open_.items() if k and c >= n), default=None)
        assert tree.tightest(n) == want
        if want is not None:
            tree.add(want, -1)
            open_[want] -= 1


def test_plan_equals_plain_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        bins: list[int] = []
        for n in sorted(sizes, reverse=True):
            fit = [i for i, b in enumerate(bins) if b >= n]
            if fit:
                i = min(fit, key=lambda i: bins[i])
                bins[i] -= n
            else:
                bins.append(64 - n)
        assert packing.plan(dict(Counter(sizes)), 64)[1] == len(bins)


def test_pack(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*corpus(), (96, "two  spaces \n\n lines\t'll don't"), (97, "<|endoftext|> x"), (98, "a<|endoftext|>b <|endoftext|><|endoftext|>"), (99, "a <|endoftext| >  <|endoftext|> b"), (93, "a")]
    got = packing.pack(frame(spark, rows), capacity=64).toPandas()
    seen = got.sort_values(["sequence_id", "offset"])
    for _, s in seen.groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    by_doc: dict[int, list[list[int]]] = {}
    for d, text in rows:
        by_doc.setdefault(d, []).append(t.encode(text or "", add_special_tokens=False).ids + [0])
    for d, texts in by_doc.items():
        own = got[got.doc_id == d]
        assert sorted(own.length) == sorted(n for x in texts for n in ([(len(x) - 1) % 64 + 1] + [64] * ((len(x) - 1) // 64)))
        if len(texts) == 1:
            ids = b"".join(own.sort_values("piece").ids)
            assert np.frombuffer(ids, "<u4").tolist() == texts[0]
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


# -- personal data --


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base(text):
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15)
            if not bad:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    rng = random.Random(7)
    parts = ["a@b.c", "a.b@c-d.e_f@g.hi", "@x.y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111111111111111", "+1 (990) 555-1864", "+1 2", "+12345678 ((", "é", " ", "\n", "x", "12", "-", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(300)] + ODD
    got = pii.find(frame(spark, rows)).select("doc_id", pii.written_spans(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {d: base(t) for d, t in rows}


def test_disclosing_terms(spark):
    rows = [(i, f"Dear Zorblax number {i} line at zor{i % 1}@mail.com about topic{i}\nother words here") for i in range(6)]
    rows += [(10 + i, f"plain words about number {i} line") for i in range(40)]
    got = {r.doc_id: [t.term for t in r.terms] for r in pii.find(frame(spark, rows)).collect()}
    assert all("Zorblax" in got[i] for i in range(6)) and not any(got[10 + i] for i in range(40))
    assert all("number" not in got[i] for i in range(6))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "[EMAIL]" in clean[0] and "Zorblax" not in clean[0] and clean[10] == rows[6][1]
    assert pii.find(frame(spark, rows).limit(0)).count() == 0


def test_disclosing_terms_of_rare_entities(spark):
    rows = [(i, f"plain words about number {i % 7} line") for i in range(60)]
    rows += [(100, "words about Quillon at once@mail.com line\nplain words"), (None, "words about Norvane at never@mail.com line")]
    rows += [(200 + i, f"plain words {i % 5}\nSigned Brastow sig@mail.com words") for i in range(20)]
    found = {r.doc_id: {t.term: t.drop for t in r.terms} for r in pii.find(frame(spark, rows)).collect()}
    n = len(rows)
    assert found[100] == {"Quillon": False} and found[None] == {"Norvane": False}  # ln(n / 2) / ln(n) = 0.85
    assert all(set(found[200 + i]) == {"Signed", "Brastow"} for i in range(20)) and not any(found[i] for i in range(60))
    share = pii.find(frame(spark, rows)).where("doc_id = 100").first().terms[0].share
    assert share == pytest.approx(np.log(n / 2) / np.log(n))
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[100] == "words about [NAME] at [EMAIL] line\nplain words" and "Brastow" not in clean[205]


# -- contamination --


def test_contamination(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(900)]
    items = [(i, words(rng, rng.randint(3, 40), vocab)) for i in range(12)] + [(20, None), (21, ""), (0, "dup id words here again one two")]
    rows = [(i, words(rng, 150, vocab)) for i in range(10)] + ODD
    for i in range(12):
        w = items[i][1].split()
        if i % 3 == 2 and len(w) > 25:
            w[len(w) // 2] = "changed"
        rows.append((30 + i, words(rng, 40, vocab) + " " + " ".join(w).upper().replace(" ", ", ") + "! " + words(rng, 40, vocab)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.similarity for r in contamination.find(frame(spark, rows), bench).collect()}
    assert got == pytest.approx(brute_contamination(rows, items))
    kept = {r.doc_id for r in contamination.remove(frame(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}
    assert contamination.find(frame(spark, rows), bench.limit(0)).count() == 0


def brute_contamination(rows, items):
    def toks(t):
        return re.sub(r"[!-/:-@\[-`{-~]", " ", (t or "").lower()).encode().split()

    def grams(w, k):
        return [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]

    bags = [(i, min(5, len(w)), Counter(grams(w, min(5, len(w))))) for i, t in items if (w := toks(t))]
    df = Counter(g for _, _, b in bags for g in b)
    out = {}
    for d, t in rows:
        w = toks(t)
        for i, k, bag in bags:
            s = grams(w, k) if len(w) >= k else []
            n = min(sum(bag.values()), len(s))
            for a in range(len(s) - n + 1) if n else ():
                x = Counter(s[a : a + n])
                wt = lambda g: 1 / df.get(g, 1)
                both = sum(wt(g) * min(c, bag[g]) for g, c in x.items())
                total = sum(wt(g) * c for b in (x, bag) for g, c in b.items())
                if both / (total - both) >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), both / (total - both))
    return out


def test_contamination_of_repeated_items(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"u{i}" for i in range(59)]
    shared = [[f"t{i}" for i in range(59)] for _ in range(10)]  # one template, the last word differs
    for i, w in enumerate(shared):
        w[-1] = f"own{i}"
    items = [(1, " ".join(base)), (2, " ".join(base))] + [(10 + i, " ".join(w)) for i, w in enumerate(shared)] + [(30 + i, words(rng, 20, [f"z{j}" for j in range(500)])) for i in range(20)]
    changed, near = list(base), list(shared[0])
    changed[30], near[30] = "changed", "changed"
    rows = [(1, " ".join(changed)), (2, "before it " + " ".join(near) + " after it"), (3, items[-1][1]), (4, "nothing of it here at all")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")

    def found():
        return {(r.doc_id, r.item_id): r.similarity for r in contamination.find(docs, bench).collect()}

    one = found()
    assert one[1, 1] == one[1, 2] == one[2, 10] == pytest.approx(50 / 60)
    assert {i: x for (d, i), x in one.items() if d == 2 and i > 10} == pytest.approx({10 + i: 49 / 61 for i in range(1, 10)})
    assert {d for d, _ in one} == {1, 2, 3}
    monkeypatch.setattr(contamination, "ITEMS", 3)
    assert len(list(contamination._blocks(bench))) > 5
    assert found() == one
    assert {r.doc_id for r in contamination.remove(docs, bench).collect()} == {4}


def test_hamming_index_is_whole():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 50).astype(np.uint64)
    flips = np.array([int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 26), replace=False))) for _ in range(400)], np.uint64)
    prints = items[rng.integers(0, 50, 400)] ^ flips
    got = set(zip(*(x.tolist() for x in contamination.candidates(prints, items, contamination.multi_index(items))), strict=True))
    assert got == {(a, b) for a in range(400) for b in range(50) if int(prints[a] ^ items[b]).bit_count() <= contamination.RADIUS}


def test_radius_recall():
    """Of pairs at a similarity of 0.8 and more, with shingles of equal and of unequal weights, hardly one lies beyond RADIUS."""
    rng = random.Random(31)
    far = total = 0
    for _ in range(4000):
        n = rng.randint(12, 120)
        heavy = rng.random() < 0.5
        bag = Counter({rng.getrandbits(64): rng.choice([1, 1, 1, 2, 5]) if heavy else 1 for _ in range(n)})
        other = Counter(bag)
        while True:
            was = Counter(other)
            other[rng.choice(list(other))] -= 1
            other = +other
            other[rng.getrandbits(64)] += 1
            if contamination.Index._similar(bag, other) < 0.8:
                break
        total += 1
        prints = [contamination.Index._print(None, x) for x in (bag, was)]
        far += (prints[0] ^ prints[1]).bit_count() > contamination.RADIUS
    assert far <= 0.002 * total  # all stand just above 0.8, the farthest that count


def test_contamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    rows = [(None, item), (5, item), (5, item), (6, "x " * 30_000 + item), (7, None)]
    got = Counter((r.doc_id, r.item_id) for r in contamination.find(frame(spark, rows), bench).collect())
    assert got == Counter({(None, 1): 2, (None, None): 1, (5, 1): 4, (5, None): 2, (6, 1): 2, (6, None): 1})
    assert contamination.remove(frame(spark, rows), bench).columns == ["doc_id", "text", "n", "key", "h"]
    assert contamination.find(frame(spark, rows).limit(0), bench).count() == 0


# -- language --


def test_language(spark):
    rng = random.Random(4)
    langs = {"aa": ["thing", "ation", "the", "hand", "with"], "bb": ["ueil", "ment", "eaux", "oir", "quel"]}
    rows = [(i, words(rng, 60, v), k) for i, (k, v) in enumerate([(k, v) for k, v in langs.items()] * 40)]
    df = spark.createDataFrame([*rows, (900, "x y", None), (901, None, "aa")], "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id < 40 or doc_id >= 900").select("text", "lang"))
    assert set(model) == {"aa", "bb"} and all(0 < len(v) <= 32768 for v in model.values())
    ask = df.select("doc_id", "text").union(spark.createDataFrame([(902, ""), (903, "123 !!"), (904, "the hand " * 40000)], "doc_id long, text string")).withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(ask, model).collect()}
    assert all(got[i][0] == k for i, _, k in rows) and got[904][0] == "aa"
    assert got[901] == got[902] == got[903] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in langid.identify(ask, {}).collect()} == {"und"}
    kept = {r.doc_id for r in langid.keep_identified(df, model).collect()}
    assert kept >= {i for i, _, _ in rows} and 901 not in kept


def test_language_equals_plain_compression(spark):
    """identify against one compressor a language and a whole text, without blocks, batches or Spark."""
    import zstandard

    rng = random.Random(5)
    langs = {"aa": ["thing", "ation", "the"], "bb": ["ueil", "ment", "oir"], "cc": ["thing", "oir", "szcz"]}
    rows = [(i, words(rng, rng.randint(5, 200), v), k) for i, (k, v) in enumerate(list(langs.items()) * 15)]
    rows += [(None, "The HAND, with 12 things", "aa"), (3, rows[3][1], "cc"), (3, rows[3][1], "cc"), (700, "thing " * 30_000, None), (701, "\u00e9t\u00e9", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.where("lang is not null").select("text", "lang"))
    want = []
    for d, t, _ in rows:
        data = b" " + b" ".join(re.sub(r"[\x00-\x08\x0e-\x1b!-@\[-`{-\x7f]", "", re.sub("[A-Z]", lambda m: m[0].lower(), t)).encode().split()) + b" "
        sizes = []
        for k in sorted(model):
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=False, write_dict_id=False))
            sizes.append((sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)), k))
        sizes.sort()
        want.append((str(d), sizes[0][1], round(1 - sizes[0][0] / sizes[1][0], 9)))
    got = [(str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in langid.identify(df, model).collect()]
    assert sorted(got) == sorted(want)
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    import zlib

    assert all(h == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, h in held.items())


# -- Jaccard --


def brute_components(rows, k, num, den):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 1, 2)])
def test_jaccard(spark, k, num, den):
    rows = corpus(k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(frame(spark, rows), k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_jaccard_edges(spark):
    rows = [(None, "a b c"), (1, "a b c"), (2, "a b c"), (2, "a b c"), (3, None)]
    got = sorted(map(tuple, jaccard.components_of(frame(spark, rows), 5, 80, 100).collect()), key=str)
    assert got == sorted([(None, 1, None), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 0, 3)], key=str)
    kept = jaccard.keep_one(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None"] and kept[0].key == "x"
    assert jaccard.components_of(frame(spark, rows).limit(0)).count() == 0


def test_jaccard_of_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, a), (7, b), (3, a + " x"), (9, b + " y"), (5, "z " + b)]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.components_of(frame(spark, rows), 5, 80, 100).collect())
    assert got == [(3, 3), (5, 5), (7, 3), (7, 5), (9, 5)]


@pytest.mark.parametrize("block", [jaccard.BLOCK_TOKENS, 300])
def test_jaccard_in_rooms(spark, monkeypatch, block):
    """Near copies that share edits among themselves, but many of which don't link with the text that they all copy."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rng = random.Random(17)
    base_ = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base_))]
    for i in range(1, 70):
        w = list(base_)
        for cut in range(rng.randint(0, 4)):
            at = rng.randrange(12) * 5
            w[at] = f"edit{at}" if rng.random() < 0.7 else f"own{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(frame(spark, rows), 4, 85, 100).collect()}
    assert got == brute_components(rows, 4, 85, 100)
    assert len({c for _, c in got.values()}) > 5


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 80) if i % 9] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(25)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# -- pages --

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many cookies, really a lot of cookies on this page, please accept all of them now.</p></div>
<div class="post post-{n}"><h1>Head &amp; more</h1><p><b>First   para.<br><p>Second&nbsp;one<p>Third <a href="/x">link</a></p><div class="ad">Buy</div><ul><li>one<li>two</ul>
<form><p>Your mail</p></form><section class="comments"><p>Nice article, I liked it very much indeed, thanks.</p></section></div>
<aside><p>Related stories and other long texts that are longer than the article itself, by far, and go on and on.</p></aside><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"https://User@Host.com:80/{i}", PAGE.replace("{n}", str(i))) for i in range(3)] + [(8, None, None), (9, "x", ""), (10, "http://o.org", "just <b>text</b>"), (11, "http://o.org/<", "<p>open <!-- gone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit(1))
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    want = "Head & more\nFirst para.\nSecond one\nThird link\none\ntwo"
    assert got == {0: want, 1: want, 2: want, 8: "", 9: "", 10: "just text", 11: "open"}
    path = pages.host_paths(df.where("page_id < 3")).first()
    assert path.host == "host.com" and path.path == ">html>body>div.post.post-#"


BODIES = {
    # page -> what of it is the article's
    "<article><h1>Head</h1><p>A lead</p><div class=body><p>" + "Body text goes on. " * 30 + "</p></div></article>": "Head\nA lead\n" + ("Body text goes on. " * 30).strip(),
    "<main><section class=intro><p>An introduction of some words</p></section><section class=body><p>" + "The longer part. " * 20 + "</p></section></main>": "An introduction of some words\n" + ("The longer part. " * 20).strip(),
    '<div id=wrap><div class=links><a href=a>One link here</a> <a href=b>Another link here</a></div><div class=story><h2>Title</h2><div class=txt><p>' + "Told at length. " * 20 + "</p></div></div></div>": "Title\n" + ("Told at length. " * 20).strip(),
    '<article><div class="article-header"><h1>Head</h1></div><div class="share-price"><p>Shares rose</p></div><p>' + "More of it. " * 20 + '</p><div class="ad-slot">Buy</div><div class="share-buttons">Tweet</div></article>': "Head\nShares rose\n" + ("More of it. " * 20).strip(),
    '<div class="site-header"><p>The site</p></div><div class="cookie-notice">We set cookies</div><div class=post><p>' + "Post text. " * 20 + '</p></div><div id="reader-comments"><p>' + "I disagree. " * 40 + "</p></div>": ("Post text. " * 20).strip(),
    '<article><header class="header"><h1>Kept</h1></header><p>' + "Words. " * 9 + "</p><table><tr><td>a</td><td>b &lt; c</td></tr></table><pre>x\n  y</pre></article><article class=comment><p>" + "No. " * 90 + "</p></article>": "Kept\n" + ("Words. " * 9).strip() + "\na\nb < c\nx y",
}


def test_pages_of_many_shapes(spark):
    rows = [(i, f"http://h{i}.org/{j}", html) for i, html in enumerate(BODIES) for j in range(2)]
    rows += [(100, "http://h0.org/x", next(iter(BODIES)).replace("Body text", "Other " * 20_000))]
    got = [(r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = [(i, text) for i, text in enumerate(BODIES.values()) for _ in range(2)]  # repeated rows
    assert sorted(x for x in got if x[0] < 100) == want
    assert [len(x.split()) for i, x in got if i == 100] == [3 + 30 * 20_002]
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_against_what_was_built(spark):
    """Random pages whose article is known, with parts that aren't the article's about and within it."""
    rng = random.Random(41)
    vocab = [f"word{i}" for i in range(200)] + ["caf\u00e9", "a&amp;b", "&lt;x&gt;"]
    plain = lambda t: t.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    noise = ["<nav><ul><li><a href=/>Home page</a></li></ul></nav>", "<aside><p>%s</p></aside>", '<div class="ad">%s</div>', "<form><p>%s</p><input name=q></form>", "<script>var a='</p>%s';</script>", "<footer>%s</footer>", "<!-- %s -->", '<div class="cookie-bar" id=c>%s</div>', '<section id="comments"><p>%s</p></section>']
    rows, want = [], {}
    for i in range(40):
        blocks = [words(rng, rng.randint(3, 60), vocab) for _ in range(rng.randint(2, 8))]
        junk = lambda: "".join(rng.choice(noise).replace("%s", words(rng, rng.randint(1, 90), vocab)) for _ in range(rng.randint(0, 3)))
        body = f"<h1>{blocks[0]}</h1>" + "".join(rng.choice(["<p>%s</p>", "<p>%s", "<h2>%s</h2>", "<ul><li>%s</ul>", "<blockquote>%s</blockquote>", "<div>%s</div>"]).replace("%s", b.replace(" ", rng.choice([" ", "  ", "\n", "<br>", " <b></b>"]))) + junk() for b in blocks[1:])
        rows.append((i, f"https://site{i % 3}.net/{i}", f"<html><head><title>x</title></head><body>{junk()}<article>{body}</article>{junk()}</body></html>"))
        want[i] = plain("\n".join(blocks))
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


# -- vectors --


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base_ = rng.standard_normal((60, 16))
    x = np.concatenate([base_, base_[:20] + 0.05 * rng.standard_normal((20, 16)), np.repeat(base_[:1], 5, 0), base_[1:2] * 7, base_[2:3] + 0.2 * rng.standard_normal((40, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, [float("inf")] * 16), (905, []), (906, [1.0, 0.0])]
    n = len(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = vectors._labels(near)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.links(df, 0.9, recall=0.9999, crowd=200, block=16).collect()}
    assert {i: got[i] for i in range(n)} == {i: (int(near[i].sum()), int(label[i])) for i in range(n)}
    assert {i: got[i] for i in range(900, 907)} == {i: (0, i) for i in range(900, 907)}
    assert vectors.links(df.limit(0)).count() == 0


def test_chance_of_a_cell():
    rng = np.random.default_rng(1)
    a = rng.standard_normal(200_000) * 0.447
    b = rng.uniform(0, vectors.WIDTH, 200_000)
    assert np.mean(np.floor(b / vectors.WIDTH) == np.floor((a + b) / vectors.WIDTH)) == pytest.approx(vectors.cell_chance(0.447), abs=0.01)


# -- lines --


def brute_lines(rows):
    def key(x):
        return re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))

    held: dict[str, set[int]] = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if not (len(h := held.get(key(x), ())) >= 3 and d < max(h))]
        out[d] = (len(all_), len(all_) - len(keep), "\n".join(keep))
    return out


def test_lines(spark):
    rng = random.Random(6)
    pool = [f"A common Line number {i} é" + " x" * i for i in range(12)] + ["short", "", "  padded line of many chars \t", "éééééééééééééééééééé", "ééééééééééééééééééé"]
    rows = [(i, "\n".join(rng.choice(pool).replace("common", rng.choice(["common", "COMMON"])) for _ in range(rng.randint(0, 9)))) for i in range(30)] + [(90, None), (91, "")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert lines.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_runs_compact(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(b, bytes([k])) for k in range(b, b + 3)], "doc_id long, key binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r.key): (r.n_docs, r.max_doc) for r in runs.repeated(1).collect()} == {bytes([k]): (len(o), max(o)) for k in range(7) if (o := [b for b in range(5) if b <= k < b + 3])}
    new = spark.createDataFrame([(9, bytes([k])) for k in (3, 50)], "doc_id long, key binary")
    assert [bytes(r.key) for r in runs.unseen(new).collect()] == [bytes([50])]
    assert {bytes(r.key) for r in runs.repeated(2).collect()} == {bytes([k]) for k in range(1, 6)}


def test_lines_of_repeated_ids(spark):
    line = "a line that stands in many documents"
    rows = [(1, line), (1, line + "\nother"), (2, line), (None, line), (5, "x" * 40_000 + "\n" + "y" * 19)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted((str(d), t.count("\n") + 1, 0, t) for d, t in rows)  # in two documents only, whatever their rows
    got = {(r.doc_id, r.text) for r in lines.dedup_lines(frame(spark, [*rows, (9, line)])).collect()}
    assert got == {(1, ""), (1, "other"), (2, ""), (None, line), (5, rows[4][1]), (9, line)}


def test_marked_rows(spark):
    rows = frame(spark, [(None, "a"), (1, "b"), (2, "c"), (2, "d")])
    ids = spark.createDataFrame([(2,), (7,)], "doc_id long")
    assert sorted(r.text for r in shared.without(rows, ids).collect()) == ["a", "b"]
    near, far = shared.marked(rows, ids)
    assert near.count() >= 2 and near.count() + far.count() == 4


# -- licences --


def test_licences(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    rows = [(1, mit), (2, "Text.\nReleased under the MIT License."), (3, "Licensed under the Apache License, Version 2.0."), (4, "no licence here"), (5, None), (6, ""), (2, "All rights reserved")]
    got = sorted((r.doc_id, r.licence, r.rule.count("+")) for r in licences.scan(frame(spark, rows)).collect())
    assert got == [(1, "MIT", 3), (2, "MIT", 0), (2, "Proprietary", 0), (3, "Apache-2.0", 0)]


MIT_WRAPPED = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD_WRAPPED = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE_WRAPPED = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL_WRAPPED = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""


def test_wrapped_licences(spark):
    gpl2 = GPL_WRAPPED.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    texts = [MIT_WRAPPED, BSD_WRAPPED, APACHE_WRAPPED, GPL_WRAPPED, gpl2]
    want = [("MIT", 3), ("BSD-3-Clause", 3), ("Apache-2.0", 3), ("GPL-3.0", 2), ("GPL-2.0", 2)]
    layouts = [lambda t: t, lambda t: re.sub("(?m)^", " * ", t), lambda t: re.sub(r"(?<=\S)\n(?=[^\n])", " ", t), lambda t: re.sub(r"(?<=\S) (?=\S)", "\n", t)]
    rows = [(10 * k + i, f(t)) for k, f in enumerate(layouts) for i, t in enumerate(texts)]
    rows += [(90, "All rights\nreserved"), (91, "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"), (92, "subject to the terms of the Mozilla Public License, v. 2.0"), (93, "with permission is hereby\n\ngranted free of charge to any person obtaining a copy")]
    found = licences.scan(frame(spark, rows)).collect()
    got = sorted((r.doc_id, r.licence, r.rule.count("+")) for r in found)
    assert got == sorted([(10 * k + i, *w) for k in range(len(layouts)) for i, w in enumerate(want)] + [(90, "Proprietary", 0), (91, "Apache-2.0", 0), (92, "MPL-2.0", 0)])
    assert {(r.first_sentence, r.last_sentence) for r in found if r.doc_id == 0} == {(0, 13)}


# -- repeats --


def brute_repeats(rows, n=50):
    first: dict[bytes, int] = {}
    out = {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first.setdefault(b[i : i + n], d) < d:
                gone[i : i + n] = b"\1" * n
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeats(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    passages = [words(rng, 20, vocab) for _ in range(6)]
    rows = [(i, words(rng, rng.randint(0, 40), vocab) + rng.choice(["", " " + rng.choice(passages) + " "]) + words(rng, 10, vocab)) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1]), (42, "ab" * 200), (43, "ab" * 130 + "c"), (44, "é" * 60), (45, "xé" + "é" * 60), (46, "x" * 49), (47, "x" * 49), *ODD]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove_repeats(frame(spark, rows, extra=False).withColumn("spans", F.lit(1))).collect()}
    assert got == brute_repeats(rows)
    assert repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("length", [24, 37])
@pytest.mark.parametrize("block", [repeats.BLOCK, 300])
def test_interval_expansion(monkeypatch, block, length):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "LARGEST", block)
    rng = random.Random(12)
    texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 70))) for _ in range(60)} | {b"a" * 70, b"ab" * 40})
    docs = np.array([rng.randrange(40) for _ in texts])
    least: dict[bytes, int] = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            least[w] = min(least.get(w, d), d)
    got = repeats.least_docs(texts, docs, length)
    assert [x.tolist() for x in got] == [[least[t[i : i + length]] for i in range(len(t) - length + 1)] for t in texts]


def test_suffix_order_is_whole():
    rng = random.Random(3)
    text = np.array([rng.choice([1, 1, 2, 3]) for _ in range(400)] + [0] + [1] * 90 + [0], np.uint8)
    order, group = repeats.interval_groups(text, 50)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    for a, b, same in zip(order, order[1:], group[1:] == group[:-1], strict=False):
        x, y = raw[a : a + 50], raw[b : b + 50]
        if len(x) == len(y) == 50 and 0 not in x and 0 not in y:
            assert same == (x == y)


def test_no_transform_outgrows_a_block(monkeypatch):
    """A passage between random flanks, however often it stands."""
    rng = random.Random(4)
    passage = bytes(rng.choice(b"abcdefgh") for _ in range(90))
    sizes = []
    inner = repeats.interval_groups
    monkeypatch.setattr(repeats, "interval_groups", lambda t, n: (sizes.append(len(t)), inner(t, n))[1])
    for many in (500, 16_000):
        flank = lambda: bytes(rng.choice(b"ijklmnop") for _ in range(60))
        texts = [flank() + passage + flank() for _ in range(many)]
        own = [t[10:-10] for t in texts]
        got = repeats.least_docs(own, np.arange(many), 50)
        assert all(x[50 : 50 + 41].tolist() == [0] * 41 for x in got)
        assert max(sizes) <= repeats.LARGEST


def test_may_share_misses_none():
    rng = random.Random(21)
    base_ = bytes(rng.choice(b"abcdefgh ") for _ in range(400))
    texts = []
    for _ in range(60):
        a = rng.randrange(200)
        t = bytearray(base_[a : a + 150])
        for _ in range(rng.randrange(4)):
            t[rng.randrange(150)] = rng.choice(b"xyz")
        texts.append(bytes(t))
    texts.append(b"ab" * 100)
    m, of, at, n = repeats.runs_of(texts, 50)
    runs = {texts[o][a : a + k + 49]: int(x) for x, o, a, k in zip(m, of.tolist(), at.tolist(), n.tolist(), strict=True)}
    distinct = list(runs)
    may = repeats.may_share(distinct, 50)
    held = Counter(w for t in distinct for w in {t[i : i + 50] for i in range(len(t) - 49)})
    for t, ok in zip(distinct, may.tolist(), strict=True):
        assert ok or all(held[t[i : i + 50]] == 1 for i in range(len(t) - 49))


def test_minimizers_agree():
    rng = random.Random(2)
    x = bytes(rng.randrange(97, 103) for _ in range(3000))
    y = b"zz" + x[500:900] + b"q"
    m, k = repeats.window_minima(np.frombuffer(x, np.uint8), 50), repeats.window_minima(np.frombuffer(y, np.uint8), 50)
    assert k[2 : 2 + 351].tolist() == m[500:851].tolist()


def test_vectors_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [1.0, 0.0])]
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 0, 3), ("None", 0, None)]


def test_vectors_as_in_production(spark):
    """The defaults: a recall of at least 0.9 of the links at the threshold and above."""
    rng = np.random.default_rng(8)
    base_ = rng.standard_normal((300, 24))
    x = np.concatenate([base_, base_ + 0.3 * rng.standard_normal((300, 24)), np.repeat(base_[:2], 150, 0) + 0.1 * rng.standard_normal((300, 24))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in vectors.links(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.9).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.sum(1))) and sum(got.values()) >= 0.9 * near.sum()


# -- pipeline --


def test_pipeline_of_odd_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, __h int"
    prose = lambda k: " ".join(f"the thing number{(i * k) % 97} and that" for i in range(40))
    autre = lambda k: " ".join(f"le chose numero{(i * k) % 97} et cela" for i in range(40))
    rows = [(i, (prose if i % 2 else autre)(i + 3), "en" if i % 2 else "fr", "s", 1, "clash", 0) for i in range(24)]
    rows += [(None, prose(50), "en", None, None, None, None), (30, None, None, None, None, None, None), (31, "", "en", "s", 0, "x", 1), (5, rows[5][1], "en", "s", 1, "x", 1), (32, prose(60) * 40, None, None, None, None, None)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            was, docs = docs, shared.written(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == was.columns and docs.count() <= was.count()
        ids = [r.doc_id for r in docs.collect()]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(map(str, {r.doc_id for r in packed})) == sorted(map(str, set(ids)))
        assert not some or (None in ids and 32 in ids and 30 not in ids and len(ids) > 20)


def test_pipeline(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        was, docs = docs, shared.written(stage(spark, docs, sf), name)
        assert docs.columns == was.columns and 0 < docs.count() <= was.count()
    assert docs.count() > 0.6 * n
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert brute_components(list(texts.items()), 5, 80, 100) == {d: (x, d) for d, (x, _) in brute_components(list(texts.items()), 5, 80, 100).items()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)


KEPT = [
    '<p class="alert">Sirens were heard at noon.</p>', '<div class="cookie-recipe">Mix flour and sugar.</div>', '<div class="menu-of-the-day">Soup and bread.</div>',
    '<section class="comments-of-minister">She said it was late.</section>', '<div class="ad-hoc-committee">Nine members met.</div>', '<div id="search">The search went on.</div>', '<h2 class="share">A fair share</h2>',
]
GONE = [
    '<div class="ad">Buy now.</div>', '<div class="ad-slot">Buy two.</div>', '<div class="cookie-notice">We use cookies.</div>', '<div class="share-buttons">Tweet</div>', '<p class="ad">Buy three.</p>', '<div class="alert">Read our terms.</div>',
    '<div class="related-posts">More news.</div>', '<section class="comments">First!</section>', '<article class="comment">Second!</article>', '<div id="comments">Third!</div>', '<article class="post reply">Fourth!</article>',
]


@pytest.mark.parametrize("shell", ['<body><div class="sidebar-primary">Side.</div><article>{}</article></body>', '<body><div class="sidebar-primary">Side.</div><div class="story">{}</div></body>'])
def test_names_within_an_article_mislead(spark, shell):
    lead = "<p>" + "The council met on Monday and talked for hours about the bridge. " * 3 + "</p>"
    gone = [g for g in GONE if "article" in shell or "post reply" not in g]
    inner = lead + "".join(a + b for a, b in zip(KEPT, [*gone[: len(KEPT)]])) + "".join(gone[len(KEPT) :])
    got = pages.extract(spark.createDataFrame([(1, "http://a.example/1", shell.format(inner))], "page_id long, url string, html string")).first().text.split("\n")
    assert got[1:] == [re.sub("<[^>]*>", "", k) for k in KEPT]


def test_formulas_and_replies_that_are_posts(spark):
    html = ['<article class="post reply"><p>One whole page of text.</p></article>', "<article><p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> hold.</p></article>"]
    rows = [(i, f"http://h{i}.example/", h, "own") for i, h in enumerate(html)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == {0: "One whole page of text.", 1: "Let x=2 hold."}
