"""Line-level OCR post-processing and document assembly.

Row-local work (repair, strip, dedup, box geometry) is narrow; per-document
assembly groups by document id only.  The costly similarity is worked out only
for low-confidence lines that no cheaper test settles; the Arrow function gets
nulls for all others, in one pass over the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.functions.similarity import similarity_ratio

# Thresholds of the reference.
CONFIDENCE_THRESHOLD = 0.75
SIMILARITY_THRESHOLD = 0.85
LONGER_BY = 3
MIN_CROP_PX = 5


def confidence_gate(conf: str = "conf", threshold: float = CONFIDENCE_THRESHOLD):
    """accepted when conf >= threshold."""
    return F.col(conf) >= F.lit(threshold)


def merge_alternates(lines: DataFrame, threshold: float = CONFIDENCE_THRESHOLD,
                     min_similarity: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """L1: for low-confidence lines take the stripped alternate text when it is
    non-empty and (similar enough or longer by more than three characters).

    Output: the input columns plus ``merged`` and ``used_alternate``.
    """
    gate = F.coalesce(confidence_gate("conf", threshold), F.lit(False))
    text = F.coalesce("text", F.lit(""))  # a null line is an empty one here
    alt = F.when(~gate, X.py_strip(F.coalesce("alt_text", F.lit(""))))
    la, lb = F.length("_alt"), F.length(text)
    # cheap decisions first; 2*min(la,lb)/(la+lb) bounds the similarity from above
    settled = (F.when(gate | (F.col("_alt") == ""), False).when(la > lb + LONGER_BY, True)
               .when(F.lit(2.0) * F.least(la, lb) / (la + lb) < min_similarity, False))
    marked = lines.withColumn("_alt", alt).withColumn("_take", settled)
    open_ = F.col("_take").isNull()
    # null inputs cost the Arrow function nothing
    scored = similarity_ratio(F.when(open_, F.col("_alt")), F.when(open_, text))
    marked = marked.withColumn("_sim", scored).withColumn("used_alternate", F.coalesce("_take", F.col("_sim") >= min_similarity))
    return marked.withColumn("merged", F.when(F.col("used_alternate"), F.col("_alt")).otherwise(F.col("text"))).drop("_alt", "_take", "_sim")


def box_bounds(lines: DataFrame, box: str = "box") -> DataFrame:
    """F2 geometry: integer envelope of the polygon (truncation toward zero)."""
    xs = F.transform(F.col(box), lambda p: p["x"])
    ys = F.transform(F.col(box), lambda p: p["y"])
    return lines.withColumns({
        "x_min": F.array_min(xs).cast("int"), "x_max": F.array_max(xs).cast("int"),
        "y_min": F.array_min(ys).cast("int"), "y_max": F.array_max(ys).cast("int"),
    })


def crop_filter(lines: DataFrame, width: int, height: int, min_px: int = MIN_CROP_PX) -> DataFrame:
    """keep lines whose crop (clipped at all four image edges) is at least
    ``min_px`` in both directions."""
    b = box_bounds(lines)
    ch = F.greatest(F.lit(0), F.least("y_max", F.lit(height)) - F.greatest(F.lit(0), F.least("y_min", F.lit(height))))
    cw = F.greatest(F.lit(0), F.least("x_max", F.lit(width)) - F.greatest(F.lit(0), F.least("x_min", F.lit(width))))
    return b.withColumns({"crop_h": ch, "crop_w": cw}).filter((F.col("crop_h") >= min_px) & (F.col("crop_w") >= min_px))


def nonblank(df: DataFrame, col: str = "text") -> DataFrame:
    """rows whose text is not blank after a Unicode strip."""
    return df.filter(~X.is_blank(col))


def document_outcome(docs: DataFrame, raw_lines: DataFrame, kept_lines: DataFrame, error: str | None = None) -> DataFrame:
    """per document, detected and kept line counts and the outcome message.
    ``error`` names a column of ``docs`` with the reason for which reading a document
    failed: such a document has failed, whatever lines it left, and counts none."""
    raw = raw_lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    kept = kept_lines.groupBy("doc_id").agg(F.count("*").alias("n_kept"))
    reason = F.lit(None).cast("string") if error is None else F.col(error).cast("string")
    out = docs.select("doc_id", reason.alias("_error")).join(raw, "doc_id", "left").join(kept, "doc_id", "left")
    failed = F.col("_error").isNotNull()
    lines, left = [F.when(failed, 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint") for c in ("n_lines", "n_kept")]
    msg = (F.when(failed, F.concat(F.lit("OCR failed: "), F.col("_error")))
           .when(lines == 0, F.lit("No text detected"))
           .when(left == 0, F.lit("No valid text found"))
           .otherwise(F.lit("Text extracted")))
    return out.select("doc_id", lines.alias("n_lines"), left.alias("n_kept"), (left > 0).alias("success"), msg.alias("message"))


def repair(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    """L3 over a text column (per line: replacements, strip, drop empties)."""
    return df.withColumn(out or col, X.repair_lines(col))


def dedup(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    """L4 over a text column."""
    return df.withColumn(out or col, X.dedup_lines(col))


def assemble(line_df: DataFrame, key: str = "doc_id", order: str = "line_no", text: str = "text") -> DataFrame:
    """Lines joined by newline in reading order, one row per document."""
    return line_df.groupBy(key).agg(X.ordered_concat(text, order, "\n").alias("text"))


def content_reuse(df: DataFrame, key: str, text: str, work) -> DataFrame:
    """Compute ``work`` once per distinct content (md5 of the text) and
    join the result back to every row with that content.

    ``work`` maps a DataFrame (content_md5, text) to (content_md5, ...).  The
    distinct step is a partial aggregate, so a hot group of copies is
    collapsed map-side; the join back is an equi-join on the digest, where
    adaptive skew handling splits a hot digest.
    """
    hashed = df.select(key, F.md5(F.col(text).cast("binary")).alias("content_md5"), F.col(text).alias("_t"))
    unique = hashed.groupBy("content_md5").agg(F.first("_t").alias(text), F.min(key).alias("first_" + key))
    done = work(unique)
    left = hashed.select(key, F.col("content_md5").alias("_md5"))
    return left.join(done, F.col("_md5").eqNullSafe(F.col("content_md5"))).drop("_md5") \
        .select(key, "content_md5", *[c for c in done.columns if c != "content_md5"])


def batch_summary(results: DataFrame) -> DataFrame:
    """readable / failed counts per batch; when nothing is readable the
    details text lists every failure as ``name (reason)`` in file order."""
    counts = results.groupBy("batch_id").agg(
        F.count_if("success").cast("bigint").alias("n_readable"),
        F.count_if(~F.col("success")).cast("bigint").alias("n_failed"))
    empty = counts.filter(F.col("n_readable") == 0).select("batch_id")
    details = (results.filter(~F.col("success")).join(empty, "batch_id", "left_semi")
               .withColumn("_d", F.concat("filename", F.lit(" ("), "message", F.lit(")")))
               .groupBy("batch_id").agg(
                   F.concat(F.lit("Details: "), X.ordered_concat("_d", "doc_id", ", ")).alias("details")))
    return counts.join(details, "batch_id", "left")


def numbered_blocks(results: DataFrame, index: str = "file_no") -> DataFrame:
    """``i. File: name`` / ``Content:`` / text for every file with a text
    or a failure message; ``file_no`` is the position within the batch."""
    from scriptorium.operators.ordering import number_within

    shown = results.filter((F.col("text") != "") | (F.col("message") != ""))
    shown = shown.withColumn("_body", F.when(F.col("text") != "", F.col("text")).otherwise(F.col("message")))
    numbered = number_within(shown.select("batch_id", "doc_id", "filename", "_body"), ["batch_id"], ["doc_id"], out=index)
    return numbered.select(
        "batch_id", "doc_id", index,
        F.format_string("%d. File: %s\nContent:\n%s", F.col(index), F.col("filename"), F.col("_body")).alias("block"))


def batch_results(results: DataFrame) -> DataFrame:
    """Per batch the number of files and the successful count."""
    return results.groupBy("batch_id").agg(
        F.count("*").cast("bigint").alias("total"),
        F.count_if("success").cast("bigint").alias("succeeded"),
        F.sum(F.length("text")).cast("bigint").alias("total_chars"))


def batch_files(results: DataFrame) -> DataFrame:
    """One row per file of a batch with its outcome, text and length; the
    error is the message of a file that failed."""
    return results.select(
        "batch_id", "doc_id", "filename", F.when(F.col("success"), "completed").otherwise("failed").alias("status"),
        F.when(~F.col("success"), F.col("message")).alias("error"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
