"""Language ID by compression: a text belongs to the language whose zstandard dictionary makes it smallest.

Each language has a raw-content dictionary of `dict_bytes`, cut from a bounded sample of its labelled texts: those with
the smallest text hashes (copies count once), `bytes_per_text` of each. A whole text, in blocks of `block` bytes, is
compressed with every dictionary; the margin is the share by which the second-smallest size exceeds the smallest. A
margin of at most `min_margin` is a rejection for `keep_identified`.

Null texts and texts without a letter are `und` with score 0; ties go to the first language by name; repeated rows get
equal answers; without any labelled row every text is `und`; extra columns pass through, but for those that have the names of
the answers: `identify` replaces them, `keep_identified` keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from farwheel.llm.shared import prepare

UNKNOWN = "und"
LEVEL = 6
#: Letters A-Z fall to lower case; other ASCII signs, which are of no language, go.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SIGNS = bytes(c for c in range(128) if not (chr(c).isalpha() or chr(c).isspace()))


def _plain(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_LOWER, _SIGNS).split()) + b" "


def learn(labelled: DataFrame, dict_bytes: int = 32768, bytes_per_text: int = 1000, texts_per_lang: int = 64) -> dict[str, bytes]:
    """A dictionary for each value of `lang` from (text, lang): at most `texts_per_lang` texts of each language are read.

    Only they reach the driver: languages x texts_per_lang x bytes_per_text."""
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    least = known.select("lang", "h").withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= texts_per_lang).select("lang", "h").distinct()
    texts = known.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, bytes_per_text)).alias("text"))
    model: dict[str, list[bytes]] = {}
    for r in texts.orderBy("lang", "h").collect():
        model.setdefault(r["lang"], []).append(_plain(r["text"]))
    return {lang: b"".join(parts)[:dict_bytes] for lang, parts in model.items()}


class Classifier:
    def __init__(self, model: dict[str, bytes], block: int = 4096) -> None:
        self.block, self.coders = block, []
        for lang in sorted(model):
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.coders.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.coders or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = _plain(text)
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = sorted((sum(len(f(b)) for b in blocks), k) for k, (_, f) in enumerate(self.coders))
        best = self.coders[sizes[0][1]][0]
        return best, 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, model: dict[str, bytes], block: int = 4096, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the language (string) and the margin (double) from `text` alone, under `names`."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x dict_bytes
    rows = docs.drop(*names)
    at = rows.columns.index("text")
    schema = T.StructType(list(rows.schema.fields)).add(names[0], "string").add(names[1], "double")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = Classifier(shared.value, block)
        for b in batches:
            said = [ask(t) for t in b.column(at).to_pylist()]
            new = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema.names)

    return rows.mapInArrow(tell, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def keep_identified(docs: DataFrame, model: dict[str, bytes], min_margin: float = 0.002) -> DataFrame:
    """`docs` without rejected rows: those of no language, and those whose margin is narrow."""
    told = identify(docs, model, names=("__lang", "__margin"))
    return told.where((F.col("__lang") != UNKNOWN) & (F.col("__margin") > min_margin)).select(docs.columns)
