"""The queries of this subpackage and their SQL. Each takes (spark, sf_dir) and applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapweave.llm.bpe_codec import encode_decode
from mapweave.llm.common import table
from mapweave.llm.fm_classifier import classify
from mapweave.llm.itq import near_duplicate_vectors
from mapweave.llm.katz import score_texts
from mapweave.llm.packing import pack
from mapweave.llm.quality_rules import quality_rules
from mapweave.llm.sharding import shard
from mapweave.llm.simhash import near_duplicates
from mapweave.llm.token_counts import count_tokens
from mapweave.llm.warc import archive_pages


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), into="verdict")
    return judged.select("doc_id", "verdict.n_words", "verdict.word_chars", "verdict.n_symbols", "verdict.n_dup_lines", "verdict.n_repeat_words", "verdict.base_failed", "verdict.kept", "verdict.llr")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op7_fm_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_simhash, op4_packing, op5_quality_rules, op6_warc, op7_fm_classifier, op8_bpe_codec, op9_itq, op10_katz)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Twenty bits of the hexadecimal digest at a time, as four characters.
_DIGITS = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {15 - 5 * i}) & 31) + 1, 1)" for g in range(8) for i in range(4))

#: SQL of the queries that it can express. The others need XXH64, tokenizers, fitted models, or a search for boundaries or patterns.
ORACLES: dict[str, str] = {
    "op6_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p""",
    "op9_itq": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM low""",
}
