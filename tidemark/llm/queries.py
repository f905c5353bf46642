"""One query per operator on its whole table, and its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import dialogs, exact, fingerprints, langid, line_dedup, lm, mixing, packing, rules, simhash, token_files, warc, whitening
from tidemark.llm.tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(_table(spark, sf_dir, "documents"))


def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"), lm.held_out())


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Target weights of the supplied sources, one to five parts; a source without a name here has one.
TARGETS = {f"src{n}": float(1 + n % 5) for n in range(20)}


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, TARGETS, default=1.0)


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~rules.passes("base")).alias("base_failed"),
        rules.passes(rules.POLICY).alias("kept"),
        "failures",
    )


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = langid.fitted(docs, ~langid.held_out())
    marked = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identified(marked, network).drop("text")


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_files.round_trip(docs, vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_common_lines(docs, by_id=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.deduplicated(docs, exact.history())


def dialog_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogs.report(dialogs.damaged(turns), turns)


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprint_query,
    "op2_lm_scoring": lm_query,
    "op3_warc": warc_query,
    "op4_simhash": simhash_query,
    "op5_mixing": mixing_query,
    "op6_quality_rules": rules_query,
    "op7_language_id": language_query,
    "op8_token_files": token_query,
    "op9_packing": packing_query,
    "op10_line_dedup": line_query,
    "op11_exact_dedup": exact_query,
    "op12_conversation_repair": dialog_query,
    "op13_whitening": whitening_query,
}

_RULES_SQL = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
         coalesce(text, '') t
  from documents
), places as (
  select doc_id, unnest(w) w0, unnest(range(len(w))) p from words
), windows as (
  select *, lead(w0, 1) over o w1, lead(w0, 2) over o w2, lead(w0, 3) over o w3, lead(w0, 4) over o w4
  from places window o as (partition by doc_id order by p)
), counted as (
  select doc_id, p, w4 is not null and count(*) over (partition by doc_id, w0, w1, w2, w3, w4) > 1 again
  from windows
), covered as (
  select doc_id, max(again) over (partition by doc_id order by p rows between 4 preceding and current row) c
  from counted
), repeated as (
  select doc_id, count(*) filter (where c) n_repeat_words from covered group by doc_id
), lines as (
  select doc_id, unnest(string_split(t, chr(10))) line from words
), doubled as (
  select doc_id, count(*) n_lines, count(*) - count(distinct line) n_dup_lines
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), measured as (
  select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
         coalesce(n_lines, 0) n_lines, coalesce(n_dup_lines, 0) n_dup_lines,
         coalesce(n_repeat_words, 0) n_repeat_words
  from words left join doubled using (doc_id) left join repeated using (doc_id)
), judged as (
  select *, (n_words < 10)::int * 1 + (100 * n_repeat_words > 20 * n_words)::int * 2
    + (n_words > 0 and n_symbols / n_words > 0.1)::int * 4 + (n_lines > 0 and n_dup_lines / n_lines > 0.5)::int * 8
    + (n_words > 0 and word_chars / n_words > 40)::int * 16
    + (n_words > 0 and word_chars / n_words < 1.5)::int * 32 failures
  from measured
)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols,
       n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
       failures & 3 <> 0 base_failed, failures = 0 kept, failures::bigint failures
from judged
"""

_LINES_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) p
  from documents
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key
  from lines
), common as (
  select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) n_lines, count(*) filter (where key in (from common)) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by p) filter (where key not in (from common)), '')) kept_sha256
from keyed group by doc_id
"""

_EXACT_SQL = """
with hashed as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) text_sha256
  from documents
)
select doc_id, max(doc_id) over (partition by text_sha256) keep_id,
       count(*) over (partition by text_sha256) group_size,
       doc_id = max(doc_id) over (partition by text_sha256) kept, text_sha256
from hashed
"""

ORACLE: dict[str, str] = {
    "op6_quality_rules": _RULES_SQL,
    "op10_line_dedup": _LINES_SQL,
    "op11_exact_dedup": _EXACT_SQL,
}
