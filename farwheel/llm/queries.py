"""The queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farwheel.llm import balance, contamination, jaccard, langid, licences, lines, packing, pages, pii, prefixes, repeats, vectors, whitening

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack(docs, capacity=2048, carry={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = pii.find(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("base", pii.is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base, terms = pii.written_spans(F.col("base")), pii.written_spans(F.col("terms"), F.lit("term"))
    both = F.concat_ws(",", F.when(F.size("base") > 0, base), F.when(F.size("terms") > 0, terms))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination.find(docs, items).withColumn("similarity", F.round("similarity", 9))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()).select("text", "lang"))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard.components_of(docs.select("doc_id", "text"), k=4, num=85, den=100)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = vectors.links(vecs.select("vec_id", "embedding"), threshold=0.9)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = lines.dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut = repeats.remove_repeats(docs.select("doc_id", "text"), length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = balance.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), capacity=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefixes.trie(prefixes.shared_heads(prefixes.ordered(turns)))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii": op2_pii,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_licence_scans": op9_licence_scans,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_balanced_packing": op11_balanced_packing,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op9_licence_scans": licences.oracle_sql(),
    "op8_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
        k AS (SELECT doc_id, i, line,
                translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key
              HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id < r.keeper AS gone FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op12_conversation_prefix_trie": r"""
        WITH RECURSIVE crc(conv_id, s, i, c) AS (
            SELECT DISTINCT conv_id, conv_id::VARCHAR, 0, 4294967295::UBIGINT FROM conversations WHERE conv_id IS NOT NULL
            UNION ALL
            SELECT conv_id, s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END
            FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::UBIGINT) ELSE c END AS x FROM crc WHERE i < 8 * length(s))),
        h AS (SELECT conv_id, (xor(c, 4294967295::UBIGINT) % 4)::INTEGER AS h FROM crc WHERE i = 8 * length(s)),
        turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        built AS (SELECT h.conv_id, t.role, t.text, t.k FROM h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.k <= h.h
            UNION ALL SELECT h.conv_id, t.role, t.text, t.k FROM h JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h),
        ranked AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d FROM built),
        chains AS (SELECT conv_id, 0 AS d, '' AS p, '' AS text FROM h
            UNION ALL SELECT conv_id, d, string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d), text FROM ranked),
        node AS (SELECT d, p, count(*) AS n, min(conv_id) AS least, any_value(text) AS text FROM chains GROUP BY d, p),
        tall AS (SELECT conv_id, max(d) AS most FROM chains GROUP BY conv_id),
        ends AS (SELECT c.d, c.p, string_agg(c.conv_id::VARCHAR, ',' ORDER BY c.conv_id) AS ids FROM chains c JOIN tall t ON c.conv_id = t.conv_id AND c.d = t.most GROUP BY c.d, c.p),
        up AS (SELECT n.d, n.p, u.d AS ud, u.p AS pp, u.least AS parent FROM node n LEFT JOIN chains c ON c.conv_id = n.least AND c.d = n.d - 1 LEFT JOIN node u ON u.d = c.d AND u.p = c.p),
        kids AS (SELECT ud AS d, pp AS p, count(*) AS k FROM up WHERE ud IS NOT NULL GROUP BY ud, pp),
        told AS (SELECT n.*, coalesce(k.k, 0) AS k, up.parent,
                (n.n - 1) * length(regexp_extract_all(n.text, '[^\x20\x09-\x0D]+')) AS own
            FROM node n JOIN up USING (d, p) LEFT JOIN kids k USING (d, p)),
        sub AS (SELECT c.d, c.p, count(*) FILTER (t.k = 0) AS leaves, sum(t.own) AS saved FROM told t JOIN chains c ON c.conv_id = t.least AND c.d <= t.d GROUP BY c.d, c.p)
        SELECT t.least AS conv_id, t.d::BIGINT AS depth, t.parent AS parent_conv_id, t.n AS n_convs, t.k AS n_children,
            s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM told t JOIN sub s USING (d, p) LEFT JOIN ends e USING (d, p)
    """,
}
