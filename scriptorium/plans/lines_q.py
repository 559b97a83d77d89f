"""Queries for line repair, dedup, assembly and batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.similarity import similarity_ratio
from scriptorium.operators import lines as L
from scriptorium.plans import sqlfrag as Q
from scriptorium.plans.registry import register
from scriptorium.session import read_table
from scriptorium.sources import derived as D


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


def _lines(spark, sf):
    return D.lines(_docs(spark, sf))


@register("line_dedup", f"SELECT doc_id, {Q.dedup_lines('text')} AS text FROM documents")
def line_dedup(spark, sf):
    """L4: first-occurrence dedup of stripped lines of every document."""
    return L.dedup(_docs(spark, sf).select("doc_id", "text"))


@register("text_repair", f"SELECT doc_id, {Q.repair_lines('text')} AS text FROM documents")
def text_repair(spark, sf):
    """L3: literal OCR repairs, strip, drop empty lines."""
    return L.repair(_docs(spark, sf).select("doc_id", "text"))


@register("answer_cleanup", f"SELECT doc_id, array_to_string({Q.clean_lines('text')}, chr(10)) AS text FROM documents")
def answer_cleanup(spark, sf):
    """Strip each line, drop blanks, rejoin."""
    return _docs(spark, sf).select("doc_id", X.cleanup_lines("text").alias("text"))


@register("blank_filter", f"SELECT doc_id, line_no FROM {Q.LINES} WHERE {Q.strip('text')} <> ''")
def blank_filter(spark, sf):
    """non-blank lines."""
    return L.nonblank(_lines(spark, sf)).select("doc_id", "line_no")


@register("content_reuse", f"""
WITH h AS (SELECT doc_id, md5(text) AS content_md5, text FROM documents),
     u AS (SELECT content_md5, min(doc_id) AS first_doc_id, any_value(text) AS text FROM h GROUP BY content_md5)
SELECT h.doc_id, h.content_md5, u.first_doc_id, {Q.dedup_lines('u.text')} AS text,
       CAST(len({Q.clean_lines('u.text')}) AS BIGINT) AS n_lines
FROM h JOIN u USING (content_md5)
""")
def content_reuse(spark, sf):
    """Line dedup computed once per distinct content, joined back."""
    def work(u):
        return u.select("content_md5", "first_doc_id", X.dedup_lines("text").alias("text"),
                        F.size(X.clean_lines("text")).cast("bigint").alias("n_lines"))
    return L.content_reuse(_docs(spark, sf), "doc_id", "text", work)


@register("box_filter", f"SELECT doc_id, line_no, x_min, y_min, x_max, y_max, crop_h, crop_w FROM {Q.KEPT_BOXES}")
def box_filter(spark, sf):
    """integer envelope of each line box; tiny or clipped-away crops dropped."""
    kept = L.crop_filter(_lines(spark, sf), D.IMAGE_WIDTH, D.IMAGE_HEIGHT)
    return kept.select("doc_id", "line_no", "x_min", "y_min", "x_max", "y_max", "crop_h", "crop_w")


@register("line_assembly", f"""
WITH k AS (SELECT doc_id, line_no, {Q.strip(Q.repair('text'))} AS t FROM {Q.KEPT_BOXES}),
     a AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line_no) AS text FROM k WHERE t <> '' GROUP BY doc_id)
SELECT doc_id, {Q.dedup_lines('text')} AS text FROM a
""")
def line_assembly(spark, sf):
    """F2 -> L3 per line -> L5 in reading order -> L4 dedup."""
    kept = L.crop_filter(_lines(spark, sf), D.IMAGE_WIDTH, D.IMAGE_HEIGHT)
    fixed = kept.select("doc_id", "line_no", X.py_strip(X.apply_replacements("text")).alias("text")) \
        .filter(F.col("text") != "")
    return L.dedup(L.assemble(fixed))


@register("doc_outcome", f"""
WITH raw AS (SELECT doc_id, count(*) AS n FROM {Q.LINES} WHERE {Q.strip('text')} <> '' GROUP BY doc_id),
     kept AS (SELECT doc_id, count(*) AS n FROM {Q.KEPT_BOXES} WHERE {Q.strip('text')} <> '' GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(raw.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(kept.n, 0) AS BIGINT) AS n_kept,
       coalesce(kept.n, 0) > 0 AS success,
       CASE WHEN coalesce(raw.n, 0) = 0 THEN 'No text detected'
            WHEN coalesce(kept.n, 0) = 0 THEN 'No valid text found' ELSE 'Text extracted' END AS message
FROM documents d LEFT JOIN raw USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def doc_outcome(spark, sf):
    """outcome message per document from detected and kept line counts."""
    lines = L.nonblank(_lines(spark, sf))
    kept = L.crop_filter(lines, D.IMAGE_WIDTH, D.IMAGE_HEIGHT)
    return L.document_outcome(_docs(spark, sf), lines, kept)


@register("doc_outcome_failed", f"""
WITH raw AS (SELECT doc_id, count(*) AS n FROM {Q.LINES} WHERE {Q.strip('text')} <> '' GROUP BY doc_id),
     kept AS (SELECT doc_id, count(*) AS n FROM {Q.KEPT_BOXES} WHERE {Q.strip('text')} <> '' GROUP BY doc_id),
     d AS (SELECT doc_id, CASE WHEN n_chars % 11 = 3 THEN 'out of memory at ' || CAST(n_chars AS VARCHAR) END AS error FROM documents)
SELECT d.doc_id, CAST(CASE WHEN error IS NULL THEN coalesce(raw.n, 0) ELSE 0 END AS BIGINT) AS n_lines,
       CAST(CASE WHEN error IS NULL THEN coalesce(kept.n, 0) ELSE 0 END AS BIGINT) AS n_kept,
       error IS NULL AND coalesce(kept.n, 0) > 0 AS success,
       CASE WHEN error IS NOT NULL THEN 'OCR failed: ' || error WHEN coalesce(raw.n, 0) = 0 THEN 'No text detected'
            WHEN coalesce(kept.n, 0) = 0 THEN 'No valid text found' ELSE 'Text extracted' END AS message
FROM d LEFT JOIN raw USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def doc_outcome_failed(spark, sf):
    """F5 where reading some documents failed."""
    lines = L.nonblank(_lines(spark, sf))
    kept = L.crop_filter(lines, D.IMAGE_WIDTH, D.IMAGE_HEIGHT)
    failed = F.when(F.col("n_chars") % 11 == 3, F.concat(F.lit("out of memory at "), F.col("n_chars").cast("string")))
    return L.document_outcome(_docs(spark, sf).withColumn("error", failed), lines, kept, "error")


# Exact LCS in SQL without a DP per line where it is not needed: the aligned
# position matches give a lower bound, the per-character count minima an upper
# bound; when they meet the LCS is known, otherwise the DP row recurrence runs.
SQL_MERGE = f"""
WITH ln AS (SELECT doc_id, line_no, text, conf, {Q.strip('alt_text')} AS t FROM {Q.LINES}),
low AS (SELECT * FROM ln WHERE conf < 0.75 AND t <> '' AND NOT length(t) > length(text) + 3),
chars AS (SELECT doc_id, line_no, 'a' AS side, unnest(string_split(t, '')) AS ch FROM low
          UNION ALL SELECT doc_id, line_no, 'b', unnest(string_split(text, '')) FROM low),
hist AS (SELECT doc_id, line_no, ch, count_if(side = 'a') AS na, count_if(side = 'b') AS nb FROM chars GROUP BY ALL),
ub AS (SELECT doc_id, line_no, sum(least(na, nb)) AS upper FROM hist GROUP BY ALL),
lb AS (SELECT doc_id, line_no, t, text,
              coalesce(list_sum(list_transform(generate_series(1, least(length(t), length(text))),
                 lambda i: CASE WHEN substring(t, i::INTEGER, 1) = substring(text, i::INTEGER, 1) THEN 1 ELSE 0 END)), 0) AS lower
       FROM low),
lcs AS (SELECT lb.doc_id, lb.line_no,
               CASE WHEN lb.lower = coalesce(ub.upper, 0) THEN lb.lower ELSE {Q.lcs('lb.t', 'lb.text')} END AS l,
               length(lb.t) + length(lb.text) AS tot
        FROM lb LEFT JOIN ub USING (doc_id, line_no)),
dec AS (SELECT ln.doc_id, ln.line_no, ln.text, ln.t,
               ln.conf < 0.75 AND ln.t <> '' AND (length(ln.t) > length(ln.text) + 3
                    OR coalesce(2.0 * lcs.l / lcs.tot, 0) >= 0.85) AS take
        FROM ln LEFT JOIN lcs USING (doc_id, line_no))
SELECT doc_id, line_no, CASE WHEN take THEN t ELSE text END AS merged, take AS used_alternate FROM dec"""


@register("confidence_merge", SQL_MERGE)
def confidence_merge(spark, sf):
    """F1 + L1 + L2: low-confidence lines replaced by their alternate text
    when similar (Indel ratio >= 0.85) or longer by more than 3 characters."""
    merged = L.merge_alternates(_lines(spark, sf))
    return merged.select("doc_id", "line_no", "merged", "used_alternate")


@register("similarity_ratio", f"""
SELECT p_partkey, round({Q.ratio('p_name', 'lower(p_type)')}, 6) AS ratio FROM part
""")
def similarity_ratio_q(spark, sf):
    """L2: Indel similarity of every part name with its lower-cased type."""
    part = read_table(spark, sf, "part")
    return part.select("p_partkey", F.round(similarity_ratio(F.col("p_name"), F.lower("p_type")), 6).alias("ratio"))


@register("batch_failures", f"""
WITH r AS {Q.DOC_RESULTS},
     c AS (SELECT batch_id, CAST(count_if(success) AS BIGINT) AS n_readable,
                  CAST(count_if(NOT success) AS BIGINT) AS n_failed FROM r GROUP BY batch_id),
     d AS (SELECT batch_id, 'Details: ' || string_agg(filename || ' (' || message || ')', ', ' ORDER BY doc_id) AS details
           FROM r WHERE NOT success AND batch_id IN (SELECT batch_id FROM c WHERE n_readable = 0) GROUP BY batch_id)
SELECT c.batch_id, n_readable, n_failed, details FROM c LEFT JOIN d USING (batch_id)
""")
def batch_failures(spark, sf):
    """readable and failed files per upload batch, details when none readable."""
    return L.batch_summary(D.doc_results(_docs(spark, sf)))


@register("numbered_block", f"""
WITH r AS (SELECT *, CASE WHEN text <> '' THEN text ELSE message END AS body FROM {Q.DOC_RESULTS}
           WHERE text <> '' OR message <> ''),
     n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) AS file_no FROM r)
SELECT batch_id, doc_id, CAST(file_no AS BIGINT) AS file_no,
       CAST(file_no AS VARCHAR) || '. File: ' || filename || chr(10) || 'Content:' || chr(10) || body AS block
FROM n
""")
def numbered_block(spark, sf):
    """Numbered file blocks per batch."""
    return L.numbered_blocks(D.doc_results(_docs(spark, sf)))


@register("batch_results", f"""
SELECT batch_id, CAST(count(*) AS BIGINT) AS total, CAST(count_if(success) AS BIGINT) AS succeeded,
       CAST(sum(length(text)) AS BIGINT) AS total_chars
FROM {Q.DOC_RESULTS} GROUP BY batch_id
""")
def batch_results(spark, sf):
    """Per batch file count, successes and extracted characters."""
    return L.batch_results(D.doc_results(_docs(spark, sf)))


@register("batch_files", f"""
SELECT batch_id, doc_id, filename, CASE WHEN success THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN NOT success THEN 'OCR failed: unreadable file' END AS error, text, CAST(length(text) AS BIGINT) AS n_chars
FROM {Q.DOC_RESULTS}""")
def batch_files(spark, sf):
    """The per-file results of every batch."""
    return L.batch_files(D.doc_results(_docs(spark, sf)))


@register("content_first_seen", """
WITH h AS (SELECT doc_id, md5(text) AS content_md5 FROM documents)
SELECT h.doc_id, h.content_md5, h.doc_id = f.first_id AS is_first
FROM h JOIN (SELECT content_md5, min(doc_id) AS first_id FROM h GROUP BY content_md5) f USING (content_md5)""")
def content_first_seen(spark, sf):
    """R4 (batch form of streaming content dedup): is each document the first
    (lowest id) with its content digest; the kept rows are the deduplicated set."""
    h = _docs(spark, sf).select("doc_id", F.md5(F.col("text").cast("binary")).alias("content_md5"))
    first = h.groupBy("content_md5").agg(F.min("doc_id").alias("_f"))
    return h.join(first, "content_md5").select("doc_id", "content_md5", (F.col("doc_id") == F.col("_f")).alias("is_first"))
