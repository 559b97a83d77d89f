"""Quality-gate queries (F3) over stand-in metrics derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import quality as QL
from scriptorium.plans.registry import register
from scriptorium.session import read_table, spread
from scriptorium.sources import derived as D

SQL_METRICS = """
m AS (SELECT doc_id, CAST(n_chars % 400 AS DOUBLE) / 2.0 AS blur, CAST(doc_id % 40 AS INTEGER) AS contrast,
             CAST(n_chars % 1000 AS INTEGER) AS height FROM documents),
v AS (SELECT *, CASE WHEN blur < 100 THEN 'blurry' WHEN contrast < 15 THEN 'low_contrast'
                     WHEN height < 500 THEN 'low_resolution' ELSE 'good' END AS verdict,
             CASE WHEN blur < 100 THEN printf('The image is blurry (focus measure = %.2f)', blur)
                  WHEN contrast < 15 THEN 'The image has low contrast'
                  WHEN height < 500 THEN 'Please upload an image with higher resolution'
                  ELSE 'Image quality is good' END AS message FROM m)"""


def _metrics(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", ((F.col("n_chars") % 400).cast("double") / 2.0).alias("blur"),
                    (F.col("doc_id") % 40).cast("int").alias("contrast"),
                    (F.col("n_chars") % 1000).cast("int").alias("height"))


@register("quality_verdicts", f"WITH {SQL_METRICS} SELECT doc_id, verdict = 'good' AS ok, verdict, message FROM v")
def quality_verdicts(spark, sf):
    """F3 cascade per row of stand-in metrics."""
    return QL.verdict(_metrics(spark, sf)).select("doc_id", "ok", "verdict", "message")


@register("quality_summary", f"""WITH {SQL_METRICS}
SELECT verdict, CAST(count(*) AS BIGINT) AS n, min(blur) AS min_blur, max(blur) AS max_blur FROM v GROUP BY verdict""")
def quality_summary(spark, sf):
    """F3 aggregate: rows, blur range per verdict."""
    return QL.verdict_summary(QL.verdict(_metrics(spark, sf))).drop("median_blur_approx")


@register("quality_pixels", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) // 16 AS h FROM documents),
px AS (SELECT doc_id, h, i - 1 AS i, (i - 1) % 16 AS x, (i - 1) // 16 AS y, ord(ch) % 256 AS p
       FROM (SELECT doc_id, h, generate_subscripts(a, 1) AS i, unnest(a) AS ch
             FROM (SELECT doc_id, h, string_split(substring(text, 1, (h * 16)::BIGINT), '') AS a FROM d WHERE h > 0))),
nb AS (SELECT *, lag(p, 1) OVER w AS l, lead(p, 1) OVER w AS r, lag(p, 16) OVER w AS u, lead(p, 16) OVER w AS o
       FROM px WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lap AS (SELECT doc_id, p, CASE WHEN h = 1 THEN (CASE WHEN x = 0 THEN p ELSE l END) + (CASE WHEN x = 15 THEN p ELSE r END) + 2 * p
                               ELSE (CASE WHEN x = 0 THEN r ELSE l END) + (CASE WHEN x = 15 THEN l ELSE r END)
                                  + (CASE WHEN y = 0 THEN o ELSE u END) + (CASE WHEN y = h - 1 THEN u ELSE o END) END - 4 * p AS v FROM nb),
m AS (SELECT doc_id, max(p) - min(p) AS contrast, var_pop(v) AS blur FROM lap GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN h > 0 THEN h END AS INTEGER) AS height, CAST(contrast AS INTEGER) AS contrast, round(blur, 6) AS blur,
       CASE WHEN h = 0 THEN 'unreadable' WHEN blur < 100 THEN 'blurry' WHEN contrast < 15 THEN 'low_contrast' WHEN h < 500 THEN 'low_resolution' ELSE 'good' END AS verdict
FROM d LEFT JOIN m USING (doc_id)""")
def quality_pixels(spark, sf):
    """F3 from pixels: every document as a gray image, its metrics and verdict."""
    m = QL.verdict(QL.image_metrics(D.text_images(spread(read_table(spark, sf, "documents").select("doc_id", "text")))))
    return m.select(F.col("path").cast("bigint").alias("doc_id"), "height", "contrast", F.round("blur", 6).alias("blur"), "verdict")
