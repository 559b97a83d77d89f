"""Document scans and text assembly from parts (S1-S6, L6 entry point).

``scan_files`` reads any directory tree with the ``binaryFile`` source and
routes each file by its extension; text-like files are decoded on the
executors, other formats keep a status row so nothing disappears.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import is_blank, ordered_concat, py_strip

# Extension lists of the reference, by format class.
IMAGE_EXTS = ("png", "jpg", "jpeg", "tiff", "bmp", "gif", "webp")
VIDEO_EXTS = ("mp4", "avi", "mov", "mkv")
SHEET_EXTS = ("xlsx", "xls")
TEXT_EXTS = ("txt", "csv")
FORMAT_OF = {**{e: "image" for e in IMAGE_EXTS}, **{e: "video" for e in VIDEO_EXTS},
             "pdf": "pdf", "docx": "docx", **{e: "sheet" for e in SHEET_EXTS}, **{e: "text" for e in TEXT_EXTS}}

SAMPLE_INTERVAL = "1 second"
TABLE_BLOCK_ROWS = 1000
#: larger text files are read in parts of whole lines, of about this many bytes
MAX_FILE_BYTES, PART_BYTES = 1 << 30, 64 << 20


def file_extension(name: str | F.Column) -> F.Column:
    """Text after the last dot, lower-cased; a name without a dot is its own extension."""
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.substring_index(c, ".", -1))


def format_class(ext: F.Column) -> F.Column:
    m = F.create_map(*[x for k, v in FORMAT_OF.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[ext], F.lit("unsupported"))


def route(df: DataFrame, name: str) -> DataFrame:
    """Add ``ext`` and ``format`` (image, video, pdf, docx, sheet, text, unsupported)."""
    return df.withColumn("ext", file_extension(name)).withColumn("format", format_class(F.col("ext")))


def accepts(name: str | F.Column, kind: str) -> F.Column:
    """may a file of this name go to the ``pdf`` or ``video`` route?  The PDF guard
    wants the suffix with its dot, the video guard any name that ends so."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    if kind == "pdf":
        return low.endswith(".pdf")
    if kind == "video":
        return low.rlike(f"({'|'.join(VIDEO_EXTS)})$")
    raise ValueError(f"no guard for {kind!r}")


def url_filename(url: str | F.Column) -> F.Column:
    """Last path segment of a URL without query or fragment."""
    c = F.col(url) if isinstance(url, str) else url
    return F.substring_index(F.regexp_replace(c, r"[?#].*$", ""), "/", -1)


def decode_text(content: str | F.Column) -> F.Column:
    """Strict UTF-8 decode of bytes; any invalid sequence gives ''."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.try_validate_utf8(c.cast("string")).isNotNull(), c.cast("string")).otherwise(F.lit(""))


def scan_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_FILE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """S1 + S2: ``binaryFile`` scan, format routing, text decode for text files.

    Output: path, filename, length, ext, format, success, message, text, part_no.
    Non-text formats get ``success=false`` and a message (their extraction
    is upstream of this library), so every file keeps a row.  A text file above
    ``max_bytes`` has a row for every part (``large_text``), in order of ``part_no``;
    all other rows are part 0.  Only the content of text files is read: the other
    rows come from a listing without the content column, and the size test is
    pushed into the scan that has it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def files(*more: str) -> DataFrame:
        named = reader.load(path).select("path", "length", *more).withColumn("filename", F.substring_index("path", "/", -1))
        return route(named, "filename")

    is_text, large = F.col("format") == "text", F.col("length") > max_bytes
    whole = F.lit(0).cast("bigint").alias("part_no")
    found = [F.lit(True).alias("success"), F.lit("Text extracted successfully").alias("message")]
    text = files("content").where(~large).where(is_text) \
        .select("path", "filename", "length", "ext", "format", *found, decode_text("content").alias("text"), whole)
    rest = files().where(~is_text).select(
        "path", "filename", "length", "ext", "format", F.lit(False).alias("success"),
        F.when(F.col("format") == "unsupported", F.concat(F.lit("Unsupported file type: "), F.col("ext")))
        .otherwise(F.concat(F.lit("No extractor for format: "), F.col("format"))).alias("message"), F.lit("").alias("text"), whole)
    out = text.unionByName(rest)
    oversized = files().where(is_text & large)
    names = [r["path"] for r in oversized.select("path").collect()]  # names of files above the limit
    if not names:
        return out
    parts = large_text(spark, names, part_bytes)
    return out.unionByName(oversized.join(parts, "path").select("path", "filename", "length", "ext", "format", *found, "text", "part_no"))


def large_text(spark: SparkSession, paths: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, part_no, text): text files of any size in parts of whole lines, each of
    about ``part_bytes`` (a longer line is a part), whose texts in order are the file's.
    Spark splits the files among tasks at line ends; a split's lines are put together in
    their order.  As for small files, one invalid UTF-8 sequence makes the text ''."""
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]
    at = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    lines = spark.read.option("lineSep", "\n").text(literal).select(
        at.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("i"), "value")
    n = F.octet_length("value") + 1
    split = Window.partitionBy("path", "block").orderBy("i")
    cut = lines.withColumn("sub", F.floor((F.sum(n).over(split) - n) / part_bytes))
    parts = cut.groupBy("path", "block", "sub").agg(
        ordered_concat("value", "i", "\n").alias("text"), F.sum(n).alias("n"), F.max("size").alias("size"),
        F.max(F.try_validate_utf8("value").isNull()).alias("bad"))
    # one small row per part: its number, and whether the file ends with its last line
    sizes = parts.select("path", "block", "sub", "n", "size", "bad")
    order = Window.partitionBy("path").orderBy("block", "sub")
    every = Window.partitionBy("path")
    placed = sizes.select("path", "block", "sub", (F.row_number().over(order) - 1).cast("bigint").alias("part_no"),
                          ((F.row_number().over(order) < F.count("*").over(every)) | (F.sum("n").over(every) == F.col("size"))).alias("ends"),
                          F.max("bad").over(every).alias("wrong"))
    shown = F.when(F.col("wrong"), "").when(F.col("ends"), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return parts.select("path", "block", "sub", "text").join(placed, ["path", "block", "sub"]).where(~F.col("wrong") | (F.col("part_no") == 0)) \
        .select("path", "part_no", shown.alias("text"))


def plain_number(df: DataFrame, col: str) -> F.Column:
    """Text of a column as CSV shows it: floating values of magnitude 1e-15 to 1e16
    in plain decimals (``15000000.0``, ``0.0001``), everything else as Spark casts it."""
    c = F.col(col)
    if df.schema[col].dataType.typeName() not in ("double", "float"):
        return c.cast("string")
    shown = c.cast("string")
    fixed = shown.try_cast("decimal(38,22)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
    return F.when(shown.contains("E") & F.abs(c).between(1e-15, 1e16 - 1), F.coalesce(plain, shown)).otherwise(shown)


def table_to_text(df: DataFrame, order: list[str], block_rows: int = TABLE_BLOCK_ROWS) -> DataFrame:
    """S3: row blocks of ``block_rows`` in ``order``, each rendered as CSV
    with a header (minimal quoting, newline line ends).

    Output: block_no BIGINT (0-based), n_rows, text.  The global row index
    is a sum of counts (no single-task window); each block is a bounded group.
    """
    from scriptorium.operators.ordering import number_rows

    cols = df.columns
    header = ",".join(cols)

    def q(c: str) -> F.Column:
        v = F.coalesce(plain_number(df, c), F.lit(""))
        need = v.rlike('[,"\r\n]')
        return F.when(need, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    rows = number_rows(df, order, out="_i").select(
        ((F.col("_i") - 1) / block_rows).cast("bigint").alias("block_no"), F.col("_i"),
        F.concat_ws(",", *[q(c) for c in cols]).alias("_line"))
    return rows.groupBy("block_no").agg(
        F.count("*").cast("bigint").alias("n_rows"),
        F.concat(F.lit(header + "\n"), ordered_concat("_line", "_i", "\n"), F.lit("\n")).alias("text"))


def coalesce_pages(pages: DataFrame, key: str = "doc_id", order: str = "page_no",
                   layer: str = "layer_text", alt: str = "alt_text", per_page: bool = False) -> DataFrame:
    """Embedded text layer first.  All pages' layer text joined by newline
    and stripped; if the document's layer is blank, the non-blank alternate
    (OCR) pages joined by newline instead.  ``per_page=True`` decides per
    page instead of per document."""
    if per_page:
        pages = pages.withColumn(layer, F.when(is_blank(layer), F.col(alt)).otherwise(F.col(layer)))
    agg = pages.withColumn("_alt_ok", ~is_blank(alt)).groupBy(key).agg(
        ordered_concat(layer, order, "\n").alias("_layer"),
        F.expr(f"listagg({alt}, '\\n') WITHIN GROUP (ORDER BY {order}) FILTER (WHERE _alt_ok)").alias("_alt"))
    layer_text = py_strip("_layer")
    use_layer = layer_text != ""
    return agg.select(key, F.when(use_layer, F.lit("layer")).otherwise(F.lit("ocr")).alias("source"),
                      F.when(use_layer, layer_text).otherwise(F.coalesce("_alt", F.lit(""))).alias("text"))


def sample_intervals(events: DataFrame, key: str, ts: str, text: str,
                     interval: str = SAMPLE_INTERVAL) -> DataFrame:
    """One sample per key and interval (the earliest row in it, of equal
    times the smallest text), blank texts dropped, samples joined by a blank line
    in time order.  Intervals count from the key's first row; a null time takes
    no part.

    Output: key, n_samples, text.  The streaming form (``scriptorium.streaming``)
    counts intervals from the epoch, as a stream does not know its start."""
    step = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))
    timed = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(text).alias("_x")).where("_t is not null")
    start = timed.groupBy(F.col(key).alias("_k")).agg(F.min("_t").alias("_t0"))
    placed = timed.join(start, F.col(key).eqNullSafe(F.col("_k")))
    samples = placed.groupBy(key, F.call_function("div", F.col("_t") - F.col("_t0"), step).alias("_w")).agg(
        F.min(F.struct("_t", "_x"))["_x"].alias("_txt"))
    kept = samples.filter(~is_blank("_txt"))
    return kept.groupBy(key).agg(
        F.count("*").cast("bigint").alias("n_samples"),
        F.expr("listagg(_txt, '\\n\\n') WITHIN GROUP (ORDER BY _w)").alias("text"))


def concat_paragraphs(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Paragraphs joined by newline in order, blank ones kept."""
    return df.groupBy(key).agg(F.count("*").cast("bigint").alias("n_paragraphs"),
                               ordered_concat(text, order, "\n").alias("text"))
