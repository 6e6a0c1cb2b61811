"""The queries of this subpackage, with production parameters, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.llm import pii
from driftmesh.llm.byte_bpe import bpe_digests
from driftmesh.llm.common import crc_of_id, table
from driftmesh.llm.exact_dedup import exact_dedup
from driftmesh.llm.lm_scoring import lm_scores
from driftmesh.llm.packing import pack_documents
from driftmesh.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from driftmesh.llm.secrets import KINDS, scan_secrets, span_text
from driftmesh.llm.simhash import simhash_components
from driftmesh.llm.toxicity import score_toxicity
from driftmesh.llm.warc import warc_round_trip

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

WHITE_SQL = r"[\x20\x09-\x0D]"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(rule) -> str:
    top, _, below = rule.measure.partition(" / ")
    value = f"({top} * 1.0 / nullif({below}, 0))" if below else top
    tests = [f"{value} >= {rule.low}"] * (rule.low != float("-inf")) + [f"{value} <= {rule.high}"] * (rule.high != float("inf"))
    return "coalesce(" + " and ".join(tests) + ", false)"


_STOPS = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))
OP1_SQL = rf"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as lines from t),
g as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as s from (select doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) as i from w)),
d as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from g) where c > 1),
v as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from d) group by doc_id),
m as (
  select w.doc_id, len(words) as n_words, length(regexp_replace(t, '{WHITE_SQL}', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) as n_letters,
    length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) as n_capitals, length(t) - length(replace(t, '!', '')) as n_shouts,
    len(list_filter(words, lambda x: lower(x) in ({_STOPS}))) as n_stop, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    len(list_filter(lines, lambda s: regexp_matches(s, '^\s*[-*•·]'))) as n_bullet_lines, len(list_filter(lines, lambda s: regexp_matches(s, '(\.\.\.|…)\s*$'))) as n_ellipsis_lines,
    coalesce(v.n, 0) as n_repeat_words
  from w left join v using (doc_id)
), f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(map(_rule_sql, RULES))} as kept from f
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = rf"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '{WHITE_SQL}', '', 'g')) as h from documents
), w as (
  select *, first_value(doc_id) over (partition by h order by n desc, doc_id) as k, count(*) over (partition by h) as g from t
)
select doc_id, k as keep_id, cast(g as bigint) as group_size, doc_id = k as kept, h as text_sha256 from w
"""


def _counts(kinds: tuple[str, ...]) -> list[Column]:
    """n_<kind> of each kind; a second argument of the condition, even one with a default, would be the place in spans."""

    def of(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    return [of(k).alias(f"n_{name}") for k, name in enumerate(kinds)]


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    counts = _counts(pii.KINDS[:4])
    base = pii.span_text(F.filter("spans", lambda s: s["kind"] < 4))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), crc_of_id() % 7 == 2, WORD_TOKENIZER)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = _counts(KINDS[:3])
    base = span_text(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
with t as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, cast(octet_length(b) as bigint) as n, sha1(b) as d from t),
g as (select *, max(page_id) over (partition by d, n) as m from h)
select page_id, n as payload_bytes, d as payload_digest,
  case when n >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> m then m end as refers_to
from g
"""

QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_packing": op2_packing, "op3_toxicity": op3_toxicity, "op5_simhash": op5_simhash, "op6_lm_scoring": op6_lm_scoring, "op7_secret_scan": op7_secret_scan, "op8_warc": op8_warc, "op4_exact_dedup": op4_exact_dedup, "op9_pii": op9_pii, "op10_byte_bpe": op10_byte_bpe}
SQL = {"op1_quality_rules": OP1_SQL, "op8_warc": OP8_SQL, "op4_exact_dedup": OP4_SQL}
