"""Names, search tokens and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to plain ones.
ACCENTS, PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüçñ", "aaaaaaeeeeiiiiooooouuuucn"
#: What makes an alert a strike.
STRIKE_CAUSE, STRIKE_WORDS = 4, "sciopero|agitazione sindacale"
#: A position in a log line, and what stands for it.
POSITION, HIDDEN = r"-?\d{1,3}\.\d{3,},-?\d{1,3}\.\d{3,}", "…"
SHADES = 6


def clean_stop_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"^Fermata \S+ - ", ""))


def fold(s: Column) -> Column:
    return F.translate(F.lower(s), ACCENTS, PLAIN)


def tokens(s: Column) -> Column:
    return F.filter(F.split(fold(s), "[^a-z0-9]+"), lambda t: t != "")


def matches_query(text: Column, query: Column) -> Column:
    """Every query token begins a token of the text, or the text's tokens joined."""
    have, want = tokens(text), tokens(query)
    joined = F.array_join(have, "")
    return (F.size(want) > 0) & F.forall(want, lambda q: F.exists(have, lambda t: F.startswith(t, q)) | F.startswith(joined, q))


def looks_like_line(query: Column) -> Column:
    return fold(F.trim(query)).rlike("^[0-9]{1,3}[a-z/]?$")


def pattern_signature(short_name: Column, route_type: Column, stop_ids: Column) -> Column:
    return F.concat_ws("|", short_name, route_type.cast("string"), F.array_join(F.transform(stop_ids, lambda x: x.cast("string")), ","))


def shade_of(short_name: Column) -> Column:
    """A polynomial hash of the name's characters, in 31 bits, over the shades of a mode."""
    codes = F.transform(F.filter(F.split(short_name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(2147483647))
    return (h % SHADES).cast("int")


def without_positions(line: Column) -> Column:
    return F.regexp_replace(line, POSITION, HIDDEN)


def mode_key(route_type: Column) -> Column:
    return F.when(route_type == 0, "tram").when(route_type == 1, "metro").when(route_type == 7, "funicular").otherwise("bus")


def draw_rank(route_type: Column) -> Column:
    return F.when(route_type == 0, 0).when(route_type == 3, 1).otherwise(2)


def version_key(version: Column) -> Column:
    """A struct that sorts as versions do: a release after its pre-releases, what doesn't parse first."""
    rx = r"^v?(\d+)\.(\d+)\.(\d+)(?:-[a-z]+\.?(\d+)(?:\.(\d+))?)?"
    part = lambda i: F.regexp_extract(version, rx, i)
    known = version.rlike(rx)
    num = lambda i, empty: F.when(known, F.when(part(i) == "", empty).otherwise(part(i).cast("int"))).otherwise(-1)
    return F.struct(num(1, 0).alias("major"), num(2, 0).alias("minor"), num(3, 0).alias("patch"), num(4, 1 << 30).alias("pre"), num(5, 0).alias("point"))


def is_strike(cause: Column, header: Column, description: Column) -> Column:
    words = f"(?i){STRIKE_WORDS}"
    return F.coalesce(cause == STRIKE_CAUSE, F.lit(False)) | F.coalesce(header, F.lit("")).rlike(words) | F.coalesce(description, F.lit("")).rlike(words)


def translation(texts: Column, language: str = "it") -> Column:
    """Of array<struct<text, language>>: the first text in the language, else the first of all, else ''."""
    have = F.filter(texts, lambda t: t["text"].isNotNull())
    own = F.filter(have, lambda t: F.coalesce(F.startswith(F.lower(t["language"]), F.lit(language)), F.lit(False)))
    return F.coalesce(F.get(own, 0)["text"], F.get(have, 0)["text"], F.lit(""))


def address_line(street: Column, number: Column, city: Column) -> Column:
    return F.concat_ws(", ", F.when(street.isNotNull(), F.concat_ws(" ", street, number)), city)


def place_name(name: Column, street: Column, number: Column, city: Column) -> Column:
    return F.coalesce(name, F.when(street.isNotNull(), F.concat_ws(" ", street, number)), city, F.lit("?"))


def duration_label(seconds: Column) -> Column:
    minutes = F.round(seconds / 60).cast("int")
    return F.when(minutes < 60, F.concat(minutes, F.lit(" min"))).otherwise(F.concat(F.floor(minutes / 60), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0")))


def metres_label(metres: Column) -> Column:
    return F.when(metres < 950, F.concat(F.round(metres).cast("int"), F.lit(" m"))).otherwise(F.concat(F.format_number(metres / 1000, "0.0"), F.lit(" km")))


def transfers_label(n: Column) -> Column:
    return F.when(n == 0, "diretto").when(n == 1, "1 cambio").otherwise(F.concat(n, F.lit(" cambi")))


def leaves_in_label(seconds: Column, same_day: Column, other_day: Column) -> Column:
    minutes = F.floor(seconds / 60)
    hours, rest = F.floor(minutes / 60), minutes % 60
    long = F.when(rest == 0, F.concat(F.lit("parte tra "), hours, F.lit(" h"))).otherwise(F.concat(F.lit("parte tra "), hours, F.lit(" h "), rest, F.lit(" min")))
    near = F.when(minutes < 60, F.concat(F.lit("parte tra "), minutes, F.lit(" min"))).otherwise(long)
    return F.when(seconds < -60, "partito").when(seconds < 60, "parte ora").when(~same_day, F.concat(F.lit("parte "), other_day)).otherwise(near)
