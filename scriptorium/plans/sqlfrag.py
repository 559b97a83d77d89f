"""DuckDB SQL fragments mirroring the Spark expressions (for the oracles)."""

from __future__ import annotations

from scriptorium.functions import text as X


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{X.STRIP_RE}', '', 'g')"


def clean_lines(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, '{X.LINE_BREAK_RE}'), "
            f"lambda s: {strip('s')}), lambda s: s <> '')")


def dedup_lines(x: str) -> str:
    return (f"array_to_string(list_filter({clean_lines(x)}, lambda s, i: "
            f"list_position({clean_lines(x)}, s) = i), chr(10))")


def repair(x: str) -> str:
    out = x
    for a, b in X.DEFAULT_REPAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def repair_lines(x: str) -> str:
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '{X.LINE_BREAK_RE}'), "
            f"lambda s: {strip(repair('s'))}), lambda s: s <> ''), chr(10))")


LINES = """
(SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text,
        ((doc_id * 31 + line_no * 17) % 100)::DOUBLE / 100.0 AS conf,
        translate(text, 'oe', '0c') AS alt_text
 FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS line_no, unnest(l) AS text
       FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""

# integer envelope of the synthetic box polygon (same arithmetic as derived.lines)
BOXES = f"""
(SELECT doc_id, line_no, text,
        trunc(list_min([x0, x0 + w, x0 + w + 0.6, x0 - 0.2]))::INTEGER AS x_min,
        trunc(list_max([x0, x0 + w, x0 + w + 0.6, x0 - 0.2]))::INTEGER AS x_max,
        trunc(list_min([y0, y0 + 0.4, y0 + h, y0 + h - 0.3]))::INTEGER AS y_min,
        trunc(list_max([y0, y0 + 0.4, y0 + h, y0 + h - 0.3]))::INTEGER AS y_max
 FROM (SELECT doc_id, line_no, text,
              ((doc_id * 7 + line_no * 3) % 50)::DOUBLE - 4.7 AS x0,
              ((line_no * 13) % 40)::DOUBLE - 5.4 AS y0,
              (length(text) % 40)::DOUBLE + 0.5 AS w,
              ((doc_id + line_no * 5) % 12)::DOUBLE + 0.2 AS h
       FROM {LINES}))"""

KEPT_BOXES = f"""
(SELECT * FROM (SELECT *, greatest(0, least(y_max, 60) - greatest(0, least(y_min, 60))) AS crop_h,
           greatest(0, least(x_max, 80) - greatest(0, least(x_min, 80))) AS crop_w
 FROM {BOXES})
 WHERE crop_h >= 5 AND crop_w >= 5)"""

DOC_RESULTS = """
(SELECT source AS batch_id, doc_id,
        'doc_' || CAST(doc_id AS VARCHAR) || '.' || (['png', 'pdf', 'txt', 'docx', 'mp4', 'csv'])[(doc_id % 6 + 1)::INTEGER] AS filename,
        ok AS success,
        CASE WHEN ok THEN 'Text extracted successfully' ELSE 'OCR failed: unreadable file' END AS message,
        CASE WHEN ok THEN text ELSE '' END AS text
 FROM (SELECT *, doc_id % 7 <> 0 AND coalesce(source <> 'src3', true) AS ok FROM documents))"""


def lcs(a: str, b: str) -> str:
    """LCS length by a DP row per character of ``b`` (nested list_reduce)."""
    zeros = f"list_transform(generate_series(0, length({a})), lambda z: 0)"
    inner = (f"list_reduce(generate_series(1, length({a})), lambda acc, j: list_append(acc, "
             f"CASE WHEN substring({a}, j::INTEGER, 1) = ch THEN prev[j] + 1 ELSE greatest(prev[j + 1], acc[j]) END), [0])")
    return (f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE "
            f"list_reduce(string_split({b}, ''), lambda prev, ch: {inner}, {zeros})[length({a}) + 1] END)")


def ratio(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE "
            f"2.0 * {lcs(a, b)} / (length({a}) + length({b})) END)")
