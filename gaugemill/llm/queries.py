"""The registered queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugemill.llm import (
    alignment, bpe, covering, decontaminate, htmltext, jaccard, linededup, ruleensemble, rules, spelling, substrings, suffixes, wordpiece,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every document."""
    pieces = wordpiece.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.count_tokens(_table(spark, sf_dir, "documents"), pieces, ["doc_id"], whole=True)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn(
        "n_chars", F.char_length("text").cast("long"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, under the base and the strict policy."""
    entries = rules.ledger(_table(spark, sf_dir, "documents"), ["doc_id"])
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(rules.BASE)).alias("base_failed"), rules.passes(rules.STRICT).alias("kept"), "failed_bits",
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels of four fifths."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = ruleensemble.fit(docs, labels.where(~held_out))
    scored = ruleensemble.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the window that is most like it."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before and lost, and the hash of what is kept, of every document."""
    return substrings.cut_passages(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and lost, and the hash of what is kept, of every document."""
    return linededup.drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes before and lost, removed runs, and the hash of what is kept, of every document."""
    return suffixes.cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, the hash of its ids, and the hash of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    ids = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                         F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(ids, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document and the smallest id of its group of near duplicates."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with its neighbours' number, the form it is a variant of, and the last form."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id of those it is linked with."""
    return covering.near_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers lie to each other in every document, and how common their links are."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        aligned = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), f.read(), g.read())
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", alignment.groups_hash().alias("groups_sha256"))


_BLANK = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

_OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM w, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, range(5) t(o) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(line) - count(DISTINCT line) AS n_dup_lines, count(line) AS n_lines
       FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
  (length(text) - length(replace(text, '!', '')))::BIGINT AS n_marks,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, :bits AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
""".replace(":bits", " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END::BIGINT" for k, c in enumerate(rules.RULES.values())))

_OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS l, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS n FROM b WHERE len(w) > 0),
ig AS (SELECT item_id, g, k, n, l, count(*) AS c FROM
        (SELECT item_id, k, n, l, array_to_string(w[o:o + k - 1], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, n + 1)) AS o)) GROUP BY ALL),
dg AS (SELECT doc_id, k, o, array_to_string(w[o:o + k - 1], ' ') AS g, len(w) AS dl
       FROM d, (SELECT DISTINCT k FROM i) s, LATERAL (SELECT unnest(range(1, greatest(len(w) - k + 2, 1))) AS o)),
s AS (SELECT DISTINCT doc_id, item_id, k, n, l, o - z AS start
      FROM (SELECT doc_id, item_id, ig.k, n, l, o, dl FROM dg JOIN ig ON dg.g = ig.g AND dg.k = ig.k), LATERAL (SELECT unnest(range(0, n)) AS z)
      WHERE o - z >= 1 AND o - z + l - 1 <= dl),
v AS (SELECT s.doc_id, s.item_id, s.n, s.l, s.start, dg.g, count(*) AS c
      FROM s JOIN dg ON s.doc_id = dg.doc_id AND s.k = dg.k AND dg.o BETWEEN s.start AND s.start + s.n - 1 GROUP BY ALL),
m AS (SELECT v.doc_id, v.item_id, v.n, v.l, v.start, sum(least(v.c, ig.c)) AS common
      FROM v JOIN ig ON v.item_id = ig.item_id AND v.g = ig.g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common DESC, start) AS place FROM m WHERE 100 * common >= 75 * (2 * n - common))
SELECT doc_id, item_id, (start - 1)::BIGINT AS start, l::BIGINT AS n_words, common::DOUBLE / (2 * n - common)::DOUBLE AS similarity FROM r WHERE place = 1
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, list_slice(words, i, i + 49) AS win FROM d, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i)),
h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY sha256(array_to_string(win, ' '))) AS first FROM w),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM h, range(50) t(o) WHERE doc_id > first),
k AS (SELECT d.doc_id, n.i, d.words[n.i] AS word, c.i IS NOT NULL AS lost
      FROM d, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) n LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = n.i)
SELECT d.doc_id, len(d.words) AS n_words, count(*) FILTER (k.lost) AS n_removed,
  sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.i) FILTER (NOT k.lost), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, len(d.words)
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)),
s AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
k AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id > s.first AS lost FROM l LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""

QUERIES = {q.__name__: q for q in (op1_token_counts, op2_html_text, op3_quality_rules, op4_quality_classifier, op5_decontamination, op6_substring_dedup, op7_line_dedup, op8_suffix_dedup, op9_byte_bpe, op10_jaccard_join,
                               op11_spelling_variants, op12_simhash_groups, op13_token_alignment)}
ORACLES = {"op3_quality_rules": _OP3, "op5_decontamination": _OP5, "op6_substring_dedup": _OP6, "op7_line_dedup": _OP7}
