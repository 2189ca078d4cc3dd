"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, extraction, licences, line_dedup, media, mixing, quality, sharding, simhash, spelling, survivorship, token_store, warc

#: A line on this many sources or more is boilerplate.
MIN_SITES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), MIN_SITES)
    return out.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "response_id", "metadata_id", "conversion_id", "payload_digest", "text_digest", "n_links", F.octet_length("text").cast("bigint").alias("text_bytes"),
        F.sha2("metadata", 256).alias("metadata_sha256"), F.sha2("conversion", 256).alias("conversion_sha256"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.golden_records(table(spark, sf_dir, "clients"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_quality_classifier, op3_source_mixing, op4_licence_scan, op5_media_columns, op6_token_output, op7_warc_derivatives, op8_simhash_near_dedup, op9_sharding, op10_decontamination, op11_golden_records, op12_html_extraction, op13_spelling_variants)
}

_FILLED = ", ".join(f"CASE WHEN NOT regexp_full_match({c}, '[\\x20\\x09-\\x0D]*') THEN {c} END AS {c}" for c in ("name", "email", "segment", "city"))
_LINES = r"string_split(coalesce(text, ''), chr(10))"
_TRIM = r"trim({}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": f"""
        WITH lines AS (SELECT source, {_TRIM.format('ln')} AS ln FROM (SELECT source, unnest({_LINES}) AS ln FROM documents)),
        known AS (SELECT ln FROM lines WHERE ln <> '' GROUP BY ln HAVING count(DISTINCT source) >= {MIN_SITES}),
        numbered AS (SELECT row_number() OVER () AS rid, doc_id, {_LINES} AS ls FROM documents),
        placed AS (SELECT rid, unnest(ls) AS ln, generate_subscripts(ls, 1) AS place FROM numbered),
        kept AS (
            SELECT rid, string_agg(p.ln, chr(10) ORDER BY place) FILTER (WHERE k.ln IS NULL) AS text, count(*) AS n_lines, count(k.ln) AS n_dropped
            FROM placed p LEFT JOIN known k ON {_TRIM.format('p.ln')} = k.ln GROUP BY rid)
        SELECT doc_id, n_lines, n_dropped, CAST(length(coalesce(text, '')) AS BIGINT) AS kept_chars, md5(coalesce(text, '')) AS kept_md5
        FROM numbered JOIN kept USING (rid)""",
    "op10_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        i AS (SELECT item_id, w, len(w) AS n, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS words FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)),
        sizes AS (SELECT DISTINCT k FROM windows),
        places AS (SELECT rid, k, p, array_to_string(w[p : p + k - 1], ' ') AS words FROM (SELECT d.*, k, unnest(range(1, greatest(1, len(w) - k + 2))) AS p FROM d, sizes)),
        hits AS (SELECT rid, p, k, item_id FROM places JOIN windows USING (k, words)),
        found AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY rid),
        words_hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT rid, p, k FROM hits)) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN found USING (rid) LEFT JOIN words_hit USING (rid)""",
    "op11_golden_records": f"""
        WITH r AS (
            SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, balance, CASE source WHEN 'partner' THEN 0 WHEN 'store' THEN 1 WHEN 'web' THEN 2 WHEN 'crm' THEN 3 ELSE 4 END AS trust,
                {_FILLED}
            FROM clients),
        s AS (SELECT *, updated_at IS NULL OR updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 720 HOUR AS stale,
                row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id NULLS LAST, name DESC NULLS LAST, email DESC NULLS LAST, segment DESC NULLS LAST, city DESC NULLS LAST, nation_id DESC NULLS LAST, balance DESC NULLS LAST) AS recent,
                (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled
            FROM r),
        t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, recent) AS trusted, first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, recent) AS chosen FROM s),
        u AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY name IS NULL, length(name) DESC, trusted) AS by_name, row_number() OVER (PARTITION BY cluster_id ORDER BY email IS NULL, trusted) AS by_email,
                row_number() OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, recent) AS by_segment, row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, trusted) AS by_address,
                row_number() OVER (PARTITION BY cluster_id ORDER BY balance IS NULL, segment IS DISTINCT FROM chosen, recent) AS by_balance
            FROM t)
        SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale, max(name) FILTER (by_name = 1) AS name, max(email) FILTER (by_email = 1) AS email, max(segment) FILTER (by_segment = 1) AS segment,
            max(city) FILTER (by_address = 1) AS city, max(nation_id) FILTER (by_address = 1) AS nation_id, CAST(max(floor(100 * balance + 0.5)) FILTER (by_balance = 1) AS BIGINT) AS balance_cents,
            max(client_id) FILTER (by_name = 1 AND name IS NOT NULL) AS name_from, max(client_id) FILTER (by_email = 1 AND email IS NOT NULL) AS email_from, max(client_id) FILTER (by_segment = 1 AND segment IS NOT NULL) AS segment_from,
            max(client_id) FILTER (by_balance = 1 AND balance IS NOT NULL) AS balance_from, max(client_id) FILTER (by_address = 1 AND filled > 0) AS address_from
        FROM u GROUP BY cluster_id""",
}
