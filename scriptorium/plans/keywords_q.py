"""Keyword queries (K1 per document, K2 per batch = source)."""

from __future__ import annotations

from scriptorium.functions.text import TOKEN_RE
from scriptorium.operators import keywords as K
from scriptorium.plans.registry import register
from scriptorium.session import read_table

_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in K.ENGLISH_STOP_WORDS)


def sql_rake(src: str, group: str, top_n: int = K.DEFAULT_TOP_N) -> str:
    g = ", ".join(x.strip() for x in group.split(","))
    join_on = " AND ".join(f"p.{x.strip()} = s.{x.strip()}" for x in group.split(","))
    return f"""
WITH t AS (SELECT {g}, regexp_extract_all(lower(text), '{TOKEN_RE}') AS toks FROM {src}),
     m AS (SELECT {g}, list_transform(toks, lambda x: CASE WHEN x IN ({_STOPS})
                    OR NOT regexp_full_match(x, '[\\p{{L}}\\p{{N}}_]+') THEN '|' ELSE x END) AS mk FROM t),
     ph AS (SELECT {g}, trim(unnest(string_split(array_to_string(mk, ' '), '|'))) AS phrase FROM m),
     pc AS (SELECT {g}, phrase, count(*) AS cnt FROM ph WHERE phrase <> '' GROUP BY ALL),
     pw AS (SELECT {g}, phrase, cnt, len(string_split(phrase, ' ')) AS plen,
                   unnest(string_split(phrase, ' ')) AS word FROM pc),
     ws AS (SELECT {g}, word, sum(cnt * plen)::DOUBLE / sum(cnt) AS word_score FROM pw GROUP BY ALL),
     sp AS (SELECT {", ".join("pw." + x.strip() for x in group.split(","))}, pw.phrase, any_value(pw.cnt) AS cnt,
                   round(sum(ws.word_score), {K.SCORE_DECIMALS}) AS score
            FROM pw JOIN ws USING ({g}, word) GROUP BY ALL),
     rk AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY {g} ORDER BY score DESC, phrase DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sp),
     cp AS (SELECT {g}, phrase, before, unnest(generate_series(1, least(cnt, {top_n} - before)::BIGINT)) AS k
            FROM rk WHERE before < {top_n}),
     kw AS (SELECT {g}, string_agg(phrase, ' ' ORDER BY before + k) AS keywords FROM cp GROUP BY ALL),
     s AS (SELECT DISTINCT {g} FROM {src})
SELECT {", ".join("s." + x.strip() for x in group.split(","))}, coalesce(p.keywords, '') AS keywords
FROM s LEFT JOIN kw p ON {join_on}
"""


@register("rake_per_doc", sql_rake("documents", "doc_id"))
def rake_per_doc(spark, sf):
    """K1: top-100 RAKE keyphrases of every document."""
    docs = read_table(spark, sf, "documents")
    return K.extract_keywords(docs, ["doc_id"], "text", colocate=True)


@register("rake_batch", sql_rake("(SELECT source, text FROM documents)", "source"))
def rake_batch(spark, sf):
    """K2: top-100 keyphrases with statistics over each batch (source)."""
    docs = read_table(spark, sf, "documents")
    return K.extract_keywords(docs, ["source"], "text")
