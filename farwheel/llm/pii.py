r"""Personal data by information-theoretic sanitisation, in built-in functions only.

Base entities are found by pattern: email, ip, card and phone. A term of an entity's line discloses it by
PMI(term; entity) / IC(entity), where IC(e) = ln(N / df(e)), PMI = ln(df(t, e) N / ((df(t) + 1) df(e))), df(t, e) counts documents
in which both share a line, and all counts are over all documents, for every entity and every term of its lines. Terms from
`generalise` on become a class of terms, from `remove` on they go. The 1 smooths small counts: a term is taken to stand in one
more document than was seen, so what was seen once is generalised and needs more documents to be removed.

The patterns match what the plain ones match, leftmost and without overlaps, but never step back: possessive repeats and
look-behinds hold every scan to linear time in texts of any length. Offsets are code points, ends exclusive.

A null text is empty; a null doc_id is a row like others; repeated rows get equal answers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farwheel.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits with at most one space or hyphen between any two: 13 to 19 of them.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_WORD = r"[\p{L}\p{N}]{3,}"
_SPAN = "array<struct<start:long,end:long,value:string>>"


def _places(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches: what lies between them gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda v, g: F.struct(F.length(g).cast("long").alias("gap"), v.alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        lo = acc["at"] + s["gap"]
        hi = lo + F.length(s["value"])
        return F.struct(hi.alias("at"), F.array_append(acc["out"], F.struct(lo.alias("start"), hi.alias("end"), s["value"].alias("value"))).alias("out"))

    return F.aggregate(steps, start, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>>: by kind as listed, then by start."""
    none = F.array().cast(_SPAN)
    least = lambda seen, spans: F.when(seen, spans).otherwise(none)  # noqa: E731  most texts hold no sign of a kind
    email = least(F.contains(text, F.lit("@")), _places(text, _EMAIL))
    ip = F.filter(least(text.rlike(r"[0-9]\.[0-9]"), _places(text, _IP)), lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    card = F.filter(least(text.rlike("[0-9][0-9 -]{11}"), _places(text, _CARD)), lambda s: F.call_function("luhn_check", _digits(s["value"])))
    phone = F.filter(least(F.contains(text, F.lit("+")), _places(text, _PHONE)), lambda s: F.length(_digits(s["value"])).between(9, 15))
    return F.concat(*(_of_kind(k, c) for k, c in zip(KINDS, (email, ip, card, phone), strict=True)))


def _of_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _entity(s: Column) -> Column:
    """What a value stands for, however it is written."""
    return F.concat(s["kind"], F.lit(":"), F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"])))


def find(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(doc_id, h, base, terms): base spans of each row of (doc_id, text) and the spans of disclosing terms.

    h is the text's hash, by which rows of one doc_id are told apart. terms: array<struct<start, end, share, term, drop>>."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("h"), "text", base_spans(F.col("text")).alias("base"))
    before = lambda s: F.substring_index(F.substring(F.col("text"), F.lit(1), s["start"].cast("int")), "\n", -1)
    after = lambda s: F.substring_index(F.substring(F.col("text"), (s["end"] + 1).cast("int"), F.lit(2**31 - 1)), "\n", 1)
    context = F.transform("base", lambda s: F.struct(_entity(s).alias("entity"), (s["start"] - F.length(before(s))).alias("at"), F.concat(before(s), s["value"], after(s)).alias("line")))
    made = written(rows.select("doc_id", "h", "base", F.when(F.size("base") > 0, context).alias("context")), "entities")

    lines = made.where("context is not null").select("doc_id", "h", "base", F.explode("context").alias("c")).select("doc_id", "h", "base", "c.entity", "c.at", "c.line")
    per = lines.groupBy("entity").agg(F.countDistinct(F.struct("doc_id", "h")).alias("df_e"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0)))
    pairs = lines.select("entity", "doc_id", "h", F.explode(words).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.countDistinct(F.struct("doc_id", "h")).alias("df_te"))
    pairs = written(pairs.join(per, "entity").select("entity", "df_e", "term", "df_te"), "pairs")
    all_words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))).alias("term"))
    df_t = all_words.groupBy("term").agg(F.count("*").alias("df_t"))
    n = made.agg(F.count("*").cast("double").alias("n"))
    share = F.log(F.col("df_te") * F.col("n") / ((F.col("df_t") + 1) * F.col("df_e"))) / F.log(F.col("n") / F.col("df_e"))
    told = pairs.join(df_t, "term").crossJoin(F.broadcast(n)).where("n > df_e").select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    told = told.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))

    spots = F.filter(
        F.transform(_places(F.col("line"), _WORD), lambda s: F.struct((F.col("at") + s["start"]).alias("start"), (F.col("at") + s["end"]).alias("end"), F.element_at("told", F.lower(s["value"])).alias("share"), s["value"].alias("term"))),
        lambda s: s["share"].isNotNull() & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    hits = lines.join(told, "entity").select("doc_id", "h", F.explode(spots).alias("s"))
    hits = hits.groupBy("doc_id", "h", "s.start", "s.end").agg(F.max("s.share").alias("share"), F.min("s.term").alias("term"))
    item = F.struct("start", "end", "share", "term", (F.col("share") >= remove).alias("drop"))
    hits = hits.groupBy(F.col("doc_id").alias("d2"), F.col("h").alias("h2")).agg(F.sort_array(F.collect_list(item)).alias("terms"))
    out = made.join(hits, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    none = F.array().cast("array<struct<start:long,end:long,share:double,term:string,drop:boolean>>")
    return out.select("doc_id", "h", "base", F.coalesce("terms", none).alias("terms"))


def written_spans(spans: Column, kind: Column | None = None) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """`docs` with `text` sanitised: entities become their kind, disclosing terms a class of terms or nothing.

    Overlapping entities of two kinds are replaced from the first on."""
    found = find(docs, generalise, remove).select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "base", "terms").distinct()
    rows = docs.withColumn("__h", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("__h") == F.col("h2")), "left")
    shape = lambda t: F.when(t.rlike("^[0-9]+$"), "[NUMBER]").when(t.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("by")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["drop"], "").otherwise(shape(s["term"])).alias("by")))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(kept, s["by"])).alias("out"))
        )

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    clean = F.aggregate(F.sort_array(F.concat(base, terms)), state, put, rest)
    return both.select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns])
