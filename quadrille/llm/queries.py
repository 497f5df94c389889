"""The queries over the test tables that apply the corpus operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontamination, exact_dedup, language_id, ngram_join, packing, quality, sharding, substring_dedup, suffix_dedup, token_output
from quadrille.llm.workspace import Workspace


def tokenizer(name: str) -> str:
    """The file of a public tokenizer that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int):
    """Whether the CRC-32 of doc_id as text leaves the remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "quality")
    described = work.table(quality.describe(table(spark, sf_dir, "documents")), "statistics")
    model = quality.learn(described, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    scored = quality.score(described, model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_query(packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=1))


def pack_query(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~held_out(4, 2)))
    return language_id.identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "tokens")
    path = work.path("orc")
    token_output.write_tokens(table(spark, sf_dir, "documents"), f"{work.root}/orc", tokenizer("word_bpe_49k.json"), end_id=2)
    return token_output.read_checksums(spark, f"{work.root}/orc")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_output": op10_token_output,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": r"""
        WITH lowered AS (SELECT 'd' AS kind, doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT 'b', NULL, item_id, text FROM benchmark),
        split AS (SELECT kind, doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
        patterns AS (SELECT DISTINCT item_id, w[k:k + least(len(w), 10) - 1] AS g FROM split, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS k) WHERE kind = 'b' AND len(w) > 0),
        lengths AS (SELECT DISTINCT len(g) AS m FROM patterns),
        docs AS (SELECT doc_id, w FROM split WHERE kind = 'd'),
        windows AS (SELECT doc_id, k, m, w[k:k + m - 1] AS g FROM docs, lengths, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS k) WHERE len(w) >= m),
        hits AS (SELECT doc_id, k, m, item_id FROM windows JOIN patterns USING (g)),
        marked AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hits, LATERAL (SELECT unnest(range(0, m)) AS j) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op5_suffix_dedup": """
        WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        digits AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM docs),
        cuts AS (SELECT doc_id, n, c, h[1024 * c + 1:1024 * c + 1422] AS s FROM digits, LATERAL (SELECT unnest(range(0, (n + 511) // 512)) AS c)),
        windows AS (SELECT doc_id, 512 * c + j AS k, s[2 * j + 1:2 * j + 400] AS g FROM cuts, LATERAL (SELECT unnest(range(0, greatest(0, least(512, n - 199 - 512 * c)))) AS j)),
        twice AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
        starts AS (SELECT doc_id, k, k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 200 AS apart FROM windows JOIN twice USING (g)),
        runs AS (SELECT doc_id, k, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM starts),
        spans AS (SELECT doc_id, min(k) AS a, max(k) + 200 AS z FROM runs GROUP BY doc_id, run),
        sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS z FROM spans GROUP BY doc_id),
        before AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM spans),
        pieces AS (SELECT doc_id, string_agg(h[2 * y + 1:2 * a], '' ORDER BY a) AS held FROM before JOIN digits USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(held, '') || h[2 * coalesce(z, 0) + 1:])) AS kept_sha256
        FROM digits LEFT JOIN sums USING (doc_id) LEFT JOIN pieces USING (doc_id)""",
    "op6_ngram_join": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (SELECT DISTINCT doc_id, w[k:k + 4] AS g FROM docs, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS k) WHERE len(w) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)""",
    "op7_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, k, w[k:k + 12] AS g FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS k) WHERE len(w) >= 13),
        firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
        gone AS (SELECT doc_id, list(DISTINCT k + j) AS places FROM windows JOIN firsts USING (g), LATERAL (SELECT unnest(range(0, 13)) AS j) WHERE doc_id > least GROUP BY doc_id),
        cells AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
        kept AS (SELECT c.doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM cells c LEFT JOIN gone g USING (doc_id) WHERE g.places IS NULL OR NOT list_contains(g.places, i) GROUP BY c.doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
        FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
