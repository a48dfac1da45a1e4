"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, bpe, exact_dedup, html_text, lang_id, packing, repeats, secrets, simhash, warc
from tessera.llm.common import table, tokenizer_path


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs)
    rows = docs.select("doc_id", lang_id.held_out().alias("held_out"), "text")
    return lang_id.annotate(rows, model, columns=["doc_id", "held_out"])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every one of ``pages``."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of ``documents``, one row per document."""
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made of ``embeddings``, those with an id divisible by 20 aligned with all: classes, components and numbers of links."""
    return audio.links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", vectors=True).withColumnRenamed("id", "vec_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of ``pages`` with revisit records, read back."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` in strings of 50 bytes that a smaller document has."""
    return repeats.removed(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of ``documents`` through a new ledger."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded."""
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM k
"""

OP7_SQL = r"""
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (
  SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) >> s) & 31)::INT + 1, 1), '' ORDER BY i, s DESC)
             FROM range(8) r(i), (VALUES (15), (10), (5), (0)) t(s)) AS payload_digest,
         max(page_id) OVER (PARTITION BY x) AS top FROM h
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""


def _op9_part(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(hit) + 1), lambda i: struct_pack(
      s := list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda g: length(g))), 0),
      e := list_sum(list_transform(gap[1:i], lambda g: length(g))) + list_sum(list_transform(hit[1:i], lambda g: length(g))), v := length(val[i]))), lambda z: z.v >= {least})) AS z
  FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}', 0) AS hit, regexp_extract_all(t, '{p}', {group}) AS val FROM d)"""


OP9_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_op9_part(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES))
    + """
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(z.s AS BIGINT) || ':' || CAST(z.e AS BIGINT), ',' ORDER BY z.s, rank) AS spans FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_audio": op6_audio,
    "op7_warc": op7_warc,
    "op8_repeats": op8_repeats,
    "op9_secrets": op9_secrets,
    "op10_bpe": op10_bpe,
}
SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op7_warc": OP7_SQL, "op9_secrets": OP9_SQL}
