"""Source queries: routing, decode, table rendering, page coalesce,
interval sampling, paragraph concat (S1-S6, F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.plans import sqlfrag as Q
from scriptorium.plans.registry import register
from scriptorium.session import read_table
from scriptorium.sources import derived as D
from scriptorium.sources import documents as S

_FORMAT_CASE = """CASE WHEN ext IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp', 'gif', 'webp') THEN 'image' WHEN ext IN ('mp4', 'avi', 'mov', 'mkv') THEN 'video'
     WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'docx' THEN 'docx' WHEN ext IN ('xlsx', 'xls') THEN 'sheet' WHEN ext IN ('txt', 'csv') THEN 'text' ELSE 'unsupported' END"""


@register("format_route", f"""
SELECT page_id, filename, ext, {_FORMAT_CASE} AS format FROM (
  SELECT page_id, filename, lower(regexp_extract(filename, '[^.]*$')) AS ext FROM (
    SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS filename FROM pages))""")
def format_route(spark, sf):
    """File name of every page URL routed to a format class."""
    pages = read_table(spark, sf, "pages").select("page_id", S.url_filename("url").alias("filename"))
    return S.route(pages, "filename")


@register("suffix_filter", f"""
SELECT doc_id, filename, CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' ELSE 'video' END AS kind FROM {Q.DOC_RESULTS}
WHERE lower(filename) LIKE '%.pdf' OR regexp_matches(lower(filename), '(mp4|avi|mov|mkv)$')""")
def suffix_filter(spark, sf):
    """PDF-route guard (.pdf suffix) and video-route guard (suffix check without a dot)."""
    r = D.doc_results(read_table(spark, sf, "documents"))
    is_pdf = S.accepts("filename", "pdf")
    return r.filter(is_pdf | S.accepts("filename", "video")).select("doc_id", "filename", F.when(is_pdf, "pdf").otherwise("video").alias("kind"))


@register("text_decode", "SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, html <> '' AS ok FROM pages")
def text_decode(spark, sf):
    """Strict UTF-8 decode of page bytes."""
    p = read_table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    t = p.select("page_id", S.decode_text("content").alias("text"))
    return t.select("page_id", F.length("text").cast("bigint").alias("n_chars"), (F.col("text") != "").alias("ok"))


def _csv_q(c: str) -> str:
    v = f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"CASE WHEN regexp_matches({v}, '[,\"\\r\\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END"


_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("table_to_text", f"""
SELECT CAST(block_no AS BIGINT) AS block_no, CAST(count(*) AS BIGINT) AS n_rows,
       '{",".join(_CUST_COLS)}' || chr(10) || string_agg(line, chr(10) ORDER BY i) || chr(10) AS text
FROM (SELECT (i - 1) // {S.TABLE_BLOCK_ROWS} AS block_no, i, line FROM (
        SELECT row_number() OVER (ORDER BY c_custkey) AS i, {" || ',' || ".join(_csv_q(c) for c in _CUST_COLS)} AS line
        FROM customer))
GROUP BY block_no""")
def table_to_text(spark, sf):
    """S3: customer table rendered as CSV text in blocks of 1000 rows."""
    c = read_table(spark, sf, "customer").select(*_CUST_COLS)
    return S.table_to_text(c, ["c_custkey"])


SQL_PAGES = f"""
pg AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY line_no) AS t
       FROM (SELECT *, CAST((line_no - 1) // 5 + 1 AS INTEGER) AS page_no FROM {Q.LINES}) GROUP BY doc_id, page_no),
dp AS (SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 THEN '' ELSE t END AS layer_text,
              translate(t, 'oe', '0c') AS alt_text FROM pg)"""


@register("page_coalesce", f"""WITH {SQL_PAGES},
agg AS (SELECT doc_id, {Q.strip("string_agg(layer_text, chr(10) ORDER BY page_no)")} AS layer,
               string_agg(alt_text, chr(10) ORDER BY page_no) FILTER (WHERE {Q.strip('alt_text')} <> '') AS alt
        FROM dp GROUP BY doc_id)
SELECT doc_id, CASE WHEN layer <> '' THEN 'layer' ELSE 'ocr' END AS source,
       CASE WHEN layer <> '' THEN layer ELSE coalesce(alt, '') END AS text FROM agg""")
def page_coalesce(spark, sf):
    """Text layer first, OCR pages only for documents with a blank layer."""
    return S.coalesce_pages(D.doc_pages(D.lines(read_table(spark, sf, "documents"))))


@register("interval_sample", f"""
WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_type || ' ' || CAST(value AS VARCHAR) AS txt FROM events),
p AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 3600000000 AS w FROM e),
s AS (SELECT user_id, w, first(txt ORDER BY ts, txt) AS txt FROM p GROUP BY user_id, w)
SELECT user_id, CAST(count(*) AS BIGINT) AS n_samples, string_agg(txt, chr(10) || chr(10) ORDER BY w) AS text
FROM s WHERE {Q.strip('txt')} <> '' GROUP BY user_id""")
def interval_sample(spark, sf):
    """One event per user and hour since the user's first event, joined by blank lines."""
    ev = read_table(spark, sf, "events").select(
        "user_id", "ts", F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("txt"))
    return S.sample_intervals(ev, "user_id", "ts", "txt", "1 hour")


@register("paragraph_concat", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_paragraphs, string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def paragraph_concat(spark, sf):
    """Conversation turns joined by newline in turn order."""
    return S.concat_paragraphs(read_table(spark, sf, "conversations"), "conv_id", "turn", "text")
