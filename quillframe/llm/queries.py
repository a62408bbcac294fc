"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.llm import chat, decontam, html_text, kn_quality, minhash, mixing, quality_rules, secret_scan, toxicity, warc
from quillframe.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_line_rules(spark, sf_dir):
    out = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept")


@query
def op5_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))[0].drop("source")


@query
def op2_main_text(spark, sf_dir):
    out = html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op3_arc_to_warc(spark, sf_dir):
    found = warc.read_archives(warc.archive_pages(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_format_chats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(turns.unionByName(own))


@query
def op1_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    leaks = F.col("leaks")
    return found.select("doc_id", F.size(leaks).cast("long").alias("n_leaks"), F.transform(leaks, lambda x: x["item_id"]).alias("item_ids"), F.array_min(F.transform(leaks, lambda x: x["edits"])).alias("least_edits"), (F.size(leaks) == 0).alias("kept"))


@query
def op7_scan_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.labelled_findings(spark)))
    n = F.size(F.filter("findings", lambda e: e["secret"]))
    return found.select("doc_id", F.size("findings").cast("long").alias("n_candidates"), n.cast("long").alias("n_secrets"), F.transform(F.filter("findings", lambda e: e["secret"]), lambda e: F.sha2(e["value"], 256)).alias("secret_digests"), F.length("clean_text").cast("long").alias("clean_chars"))


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = toxicity.score_toxicity(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


@query
def op9_kn_perplexity(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return kn_quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), trusted)


ORACLE["op3_arc_to_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM f
"""

ORACLE["op4_format_chats"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, list_sum(list_transform([role, text], lambda x:
      length(x) + length(x) - length(replace(x, chr(92), ''))
      + (length(x) - length(replace(x, '<s>', ''))) // 3 + (length(x) - length(replace(x, '</s>', ''))) // 4
      + (length(x) - length(replace(x, '[INST]', ''))) // 6 + (length(x) - length(replace(x, '[/INST]', ''))) // 7)) AS escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + 20) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: A line's rules, as quality_rules.line_fails has them; the lists of fixed values and the end marks are the same.
_SQL = {k: getattr(quality_rules, k).replace("'", "''") for k in ("NAVIGATION", "END", "END_WITHIN")}
_LINE_FAILS = rf"""
  (NOT regexp_matches(l, '{_SQL["END"]}') AND (n < 10 OR NOT regexp_matches(l, '{_SQL["END_WITHIN"]}')))
  OR 10 * (length(l) - length(translate(l, '#*$%&|<>', ''))) > length(l)
  OR (length(l) - length(replace(l, '|', '')) >= 2 AND 3 * (length(l) - length(replace(l, '|', ''))) >= n)
  OR (length(l) >= 20 AND regexp_matches(l, '[A-Z]') AND NOT regexp_matches(l, '[a-z]'))
  OR (length(l) >= 20 AND 20 * (length(l) - length(replace(l, '!', ''))) > length(l))
  OR (length(l) < 60 AND regexp_matches(l, '(?i){_SQL["NAVIGATION"]}'))
  OR {" OR ".join("contains(lower(l), '" + term.replace("'", "''") + "')" for term in quality_rules.BOILERPLATE)}
"""

ORACLE["op10_line_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM d
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '[^ 	-
]+')) AS n FROM (SELECT DISTINCT doc_id, unnest(ls) AS l FROM d)
), stay AS (
  SELECT doc_id, sum(n) AS stays FROM lines WHERE NOT ({_LINE_FAILS}) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(w) - coalesce(stays, 0) AS BIGINT) AS lost_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN stay USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, lost_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_words <= 50 * n_words AS kept
FROM c
"""
