"""Licence scans by sentence rules, in built-in functions only.

A text falls into pieces, at line ends and after . ; or : before white space; a piece is normalised: ASCII letters in lower
case, everything but letters and digits one space. Pieces up to a full stop or a blank line are a sentence; abbreviations and
numbers of a list don't end one. Each known licence sentence is a pattern with an identifier; it is sought in each piece, and
over the adjacent pieces of a sentence, since notices are wrapped and hold ; and :. A text becomes the sequence of its
identifiers, with their places. A rule is an ordered list of identifiers, each at most `gap` sentences after the one before
it; where several rules match from one place, the longest stands, and a shorter rule within its reach doesn't count again.

Null and empty texts hold nothing; a null doc_id is a row like others; repeated rows get equal answers; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sentences of public licences and usual notices, normalised, as patterns; (identifier, pattern).
SENTENCES: list[tuple[str, str]] = [
    ("mit-notice", r"(released|licensed|distributed|available) under (the )?(terms of the )?mit licen[sc]e"),
    ("mit-title", r"^(the )?mit licen[sc]e( mit)?$"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-include", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("as-is", r"the software is provided as is without warranty of any kind"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("apache2-notice", r"licensed under (the )?apache licen[sc]e( version)? 2( 0)?"),
    ("apache2-title", r"^apache licen[sc]e version 2 0( january 2004)?$"),
    ("apache2-comply", r"you may not use this (file|work|software) except in compliance with the licen[sc]e"),
    ("apache2-obtain", r"you may obtain a copy of the licen[sc]e at"),
    ("apache2-asis", r"software distributed under the licen[sc]e is distributed on an as is basis"),
    ("bsd-redistribute", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"neither the name of .{0,80}nor the names of its contributors may be used to endorse"),
    ("bsd-notice", r"(released|licensed|distributed|available) under (the )?(terms of the )?(new |modified |simplified |3 clause |2 clause )?bsd( 2| 3)?( clause)? licen[sc]e"),
    ("gpl3-notice", r"licen[sc]ed under (the )?(terms of the )?gnu general public licen[sc]e( as published by the free software foundation)?( either)? version 3"),
    ("gpl2-notice", r"licen[sc]ed under (the )?(terms of the )?gnu general public licen[sc]e( as published by the free software foundation)?( either)? version 2"),
    ("gpl-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-v3", r"either version 3 of the licen[sc]e"),
    ("gpl-v2", r"either version 2 of the licen[sc]e"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-notice", r"licen[sc]ed under (the )?(terms of the )?gnu lesser general public licen[sc]e"),
    ("agpl-notice", r"licen[sc]ed under (the )?(terms of the )?gnu affero general public licen[sc]e"),
    ("mpl2-notice", r"subject to the terms of the mozilla public licen[sc]e v(ersion)? 2 0"),
    ("cc-by-nc-notice", r"licen[sc]ed under (a |the )?(cc|creative commons)( attribution| by)( nc| noncommercial| non commercial) [0-9]"),
    ("cc-by-sa-notice", r"licen[sc]ed under (a |the )?(cc|creative commons)( attribution| by)( sa| sharealike| share alike) [0-9]"),
    ("cc-by-notice", r"licen[sc]ed under (a |the )?(cc|creative commons)( attribution| by) [0-9]"),
    ("cc0-notice", r"(cc0 1 0|dedicated to the public domain)"),
    ("rights-reserved", r"all rights reserved"),
]
#: Ordered rules, (licence, identifiers).
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-title", "mit-grant", "mit-include", "as-is"]),
    ("MIT", ["mit-grant", "mit-include", "as-is"]),
    ("MIT", ["mit-grant", "mit-include"]),
    ("MIT", ["mit-notice"]),
    ("ISC", ["isc-grant", "as-is"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply", "apache2-obtain", "apache2-asis"]),
    ("Apache-2.0", ["apache2-notice", "apache2-comply"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0", ["apache2-title"]),
    ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]),
    ("BSD", ["bsd-notice"]),
    ("GPL-3.0", ["gpl-free", "gpl-v3", "gpl-hope"]),
    ("GPL-2.0", ["gpl-free", "gpl-v2", "gpl-hope"]),
    ("GPL-3.0", ["gpl-free", "gpl-v3"]),
    ("GPL-2.0", ["gpl-free", "gpl-v2"]),
    ("GPL", ["gpl-free"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("LGPL", ["lgpl-notice"]),
    ("AGPL", ["agpl-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-NC", ["cc-by-nc-notice"]),
    ("CC-BY-SA", ["cc-by-sa-notice"]),
    ("CC-BY", ["cc-by-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Proprietary", ["rights-reserved"]),
]
#: Every known sentence holds one of these; a sentence without any is no licence's.
SIGNS = r"licen[sc]e|licen[sc]ed|permission|redistribut|copyright|warranty|rights reserved|free software|public domain|cc0|endorse|gnu|copy"
#: A piece whose full stop doesn't end its sentence: an abbreviation or a number of a list.
_GOES_ON = r"(?i)(\b(v|ver|vers|inc|co|corp|ltd|llc|no)|^[^A-Za-z0-9]*([0-9]{1,3}|[a-z]))\.[\"')\]]*\s*$"
#: Between two words of a sentence: a space, or where one piece ends and the next begins, with its place.
_BETWEEN = r"(?: |\n[0-9]+:)"


def sentences(text: Column) -> Column:
    """The pieces of a text, in order."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.;:])[ \\t\\n\\r\\f]+", "$1\n"), "\n", -1)


def normalised(sentence: Column) -> Column:
    letters = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(letters, "[^a-z0-9]+", " "))


def identified(sentence: Column) -> Column:
    """The identifier of the first known sentence that a normalised one holds, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(pattern), name).otherwise(out)
    return out


def _over_pieces(pattern: str) -> str:
    """A pattern over normalised pieces as one over a joined sentence."""
    whole = pattern.replace(".{0,80}", "(?:[a-z0-9]|<>){0,80}").replace(" ", _BETWEEN).replace("<>", _BETWEEN)
    return re.sub(r"^\^", "(?<=:)", re.sub(r"\$$", r"(?=\\n|$)", whole))


def _joined(pieces: Column) -> Column:
    """The sentences of a text: of each its normalised pieces, every one as line end, place, colon and text."""
    ends = lambda p: (normalised(p) == "") | (p.rlike(r"\.[\"')\]]*\s*$") & ~p.rlike(_GOES_ON))
    put = F.transform(pieces, lambda p, i: F.concat(F.lit("\n"), i.cast("string"), F.lit(":"), normalised(p), F.when(ends(p), "|").otherwise("")))
    # a blank piece ends the sentence before it, too
    return F.filter(F.split(F.regexp_replace(F.array_join(put, ""), r"\n[0-9]+:\|", "|"), r"\|"), lambda x: x != "")


def _marks(sentence: Column, j: Column) -> Column:
    """array<struct<p, j, i, id>> of a joined sentence. i is the piece in which a match begins; p orders matches, for one that
    runs on into the next piece comes after one within its piece."""
    pieces = F.filter(F.split(sentence, "\n"), lambda x: x.rlike(SIGNS))
    place = lambda x: F.substring_index(x, ":", 1).cast("int")
    mark = lambda p, i, name: F.struct(p.alias("p"), j.alias("j"), i.alias("i"), name.alias("id"))
    own = F.transform(pieces, lambda x: mark(2 * place(x), place(x), identified(F.substring_index(x, ":", -1))))
    over = []
    for name, pattern in SENTENCES:
        found = F.filter(F.regexp_extract_all(sentence, F.lit(_over_pieces(pattern)), F.lit(0)), lambda v: F.contains(v, F.lit("\n")))
        firsts = F.transform(found, lambda v: place(F.substring_index(F.substring_index(v, "\n", 2), "\n", -1)) - 1)
        over.append(F.transform(firsts, _named(name, lambda i, id_: mark(2 * i + 1, i, id_))))
    none = F.array().cast("array<struct<p:int,j:int,i:int,id:string>>")
    several = sentence.rlike(r"\n[^\n]*\n") & sentence.rlike(SIGNS.replace(" ", _BETWEEN))
    return F.concat(F.filter(own, lambda x: x["id"].isNotNull()), F.when(several, F.filter(F.concat(*over), lambda x: ~F.exists(own, lambda o: (o["i"] == x["i"]) & o["id"].eqNullSafe(x["id"])))).otherwise(none))


def _named(name: str, mark: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda i: mark(i, F.lit(name))


def scan(docs: DataFrame, gap: int = 3) -> DataFrame:
    """(doc_id, licence, rule, first_sentence, last_sentence) of (doc_id, text), one row a rule match; both are places of
    pieces, from 0."""
    signs = SIGNS.replace(" ", "[^a-z0-9]+")
    near = docs.where(F.lower("text").rlike(signs)).select("doc_id", F.xxhash64("text").alias("h"), _joined(sentences(F.col("text"))).alias("s"))
    marked = near.select("doc_id", "h", F.array_sort(F.flatten(F.transform("s", _marks))).alias("m")).where(F.size("m") > 0)
    later = sorted({name for _, ids in RULES for name in ids[1:]})
    reach = gap * (max(len(ids) for _, ids in RULES) - 1)  # sentences that a rule can span
    marked = marked.withColumn("later", F.filter("m", lambda x: x["id"].isin(later)))
    spots = F.transform("m", lambda x: F.struct(x.alias("f"), F.filter("later", lambda y: (y["p"] > x["p"]) & (y["j"] <= x["j"] + reach)).alias("m")))
    rows = marked.select("doc_id", "h", F.explode(spots).alias("x")).select("doc_id", "h", "x.f", "x.m")
    found = [F.struct(F.lit(len(ids)).alias("size"), _reach(ids, gap).alias("last"), F.lit(licence).alias("licence"), F.lit("+".join(ids)).alias("rule")) for licence, ids in RULES]
    best = F.array_max(F.filter(F.array(*found), lambda r: r["last"].isNotNull()))
    hits = rows.select("doc_id", "h", F.col("f.p").alias("p"), F.col("f.i").alias("first_sentence"), best.alias("b")).where("b is not null")
    hits = hits.select("doc_id", "h", "p", "b.licence", "b.rule", "first_sentence", F.col("b.last.p").alias("last_p"), F.col("b.last.i").alias("last_sentence"))
    # a match inside a longer one of the same licence isn't counted again
    earlier = Window.partitionBy("doc_id", "h", "licence").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max("last_p").over(earlier) >= F.col("last_p"), F.lit(False))
    return hits.withColumn("__in", inside).where("not __in").select("doc_id", "licence", "rule", "first_sentence", "last_sentence")


def _reach(ids: list[str], gap: int) -> Column:
    """(p, j, i) of a rule's last sentence when its first is `f`, or null."""
    place = lambda x: F.struct(x["p"].alias("p"), x["j"].alias("j"), x["i"].alias("i"))
    at = F.when(F.col("f.id") == ids[0], place(F.col("f")))
    for name in ids[1:]:
        at = _next(at, name, gap, place)
    return at


def _next(prior: Column, name: str, gap: int, place) -> Column:
    near = F.filter("m", lambda x: (x["id"] == name) & (x["p"] > prior["p"]) & (x["j"] <= prior["j"] + gap))
    return F.array_min(F.transform(near, place))


def oracle_sql(gap: int = 3) -> str:
    """`scan` over documents in DuckDB's SQL."""
    ident = "CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in SENTENCES) + " END"

    def reach(ids: list[str]) -> str:
        at = f"CASE WHEN f.id = '{ids[0]}' THEN f.i END"
        for name in ids[1:]:
            at = f"list_min(list_transform(list_filter(m, lambda x: x.id = '{name}' AND x.i > {at} AND x.i <= {at} + {gap}), lambda x: x.i))"
        return at

    rules = ", ".join(f"{{'size': {len(ids)}, 'last': {reach(ids)}, 'licence': '{licence}', 'rule': '{'+'.join(ids)}'}}" for licence, ids in RULES)
    return rf"""
        WITH s AS (SELECT doc_id, hash(text) AS h, string_split(regexp_replace(text, '([.;:])[ \t\n\r\f]+', '\1' || chr(10), 'g'), chr(10)) AS s
                   FROM documents WHERE text IS NOT NULL),
        l AS (SELECT doc_id, h, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS i FROM s),
        n AS (SELECT doc_id, h, i, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS n FROM l),
        k AS (SELECT doc_id, h, i, {ident} AS id FROM n),
        m AS (SELECT doc_id, h, list({{'i': i, 'id': id}} ORDER BY i) AS m FROM k WHERE id IS NOT NULL GROUP BY doc_id, h),
        f AS (SELECT doc_id, h, m, unnest(m) AS f FROM m),
        b AS (SELECT doc_id, h, f.i AS first_sentence, list_max(list_filter([{rules}], lambda x: x.last IS NOT NULL)) AS b FROM f),
        c AS (SELECT doc_id, h, b.licence AS licence, b.rule AS rule, first_sentence, b.last AS last_sentence FROM b WHERE b IS NOT NULL),
        w AS (SELECT *, max(last_sentence) OVER (PARTITION BY doc_id, h, licence ORDER BY first_sentence RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
        SELECT doc_id, licence, rule, CAST(first_sentence AS INT) AS first_sentence, CAST(last_sentence AS INT) AS last_sentence
        FROM w WHERE coalesce(before < last_sentence, true)
    """
