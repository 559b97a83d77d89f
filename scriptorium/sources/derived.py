"""Input tables the operators consume, derived by Spark from the supplied
tables (see FIXTURES.md section 3).  Every derivation is row-local or a
bounded per-document aggregation, and keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import ordered_concat

# Canvas of the synthetic line boxes (pixels).
IMAGE_WIDTH = 80
IMAGE_HEIGHT = 60
FILE_EXTS = ("png", "pdf", "txt", "docx", "mp4", "csv")


def lines(documents: DataFrame) -> DataFrame:
    """One row per newline-separated line of every document.

    doc_id, line_no INT (1-based), text, conf DOUBLE, box ARRAY<STRUCT<x,y>>, alt_text.
    """
    base = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "text")).select(
        "doc_id", (F.col("_p") + 1).cast("int").alias("line_no"), "text")
    d, n = F.col("doc_id"), F.col("line_no").cast("bigint")
    x0 = ((d * 7 + n * 3) % 50).cast("double") - 4.7
    y0 = ((n * 13) % 40).cast("double") - 5.4
    w = (F.length("text") % 40).cast("double") + 0.5
    h = ((d + n * 5) % 12).cast("double") + 0.2
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    box = F.array(pt(x0, y0), pt(x0 + w, y0 + 0.4), pt(x0 + w + 0.6, y0 + h), pt(x0 - 0.2, y0 + h - 0.3))
    return base.select(
        "doc_id", "line_no", "text",
        (((d * 31 + n * 17) % 100).cast("double") / 100.0).alias("conf"),
        box.alias("box"),
        F.translate("text", "oe", "0c").alias("alt_text"),
    )


def doc_pages(line_df: DataFrame) -> DataFrame:
    """Pages of five lines: doc_id, page_no INT, layer_text, alt_text.
    The text layer is empty for every third document (doc_id % 3 = 0)."""
    pages = line_df.withColumn("page_no", ((F.col("line_no") - 1) / 5).cast("int") + 1) \
        .groupBy("doc_id", "page_no").agg(ordered_concat("text", "line_no", "\n").alias("_t"))
    return pages.select(
        "doc_id", "page_no",
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("_t")).alias("layer_text"),
        F.translate("_t", "oe", "0c").alias("alt_text"),
    )


def doc_results(documents: DataFrame) -> DataFrame:
    """Per-file extraction results of upload batches (batch = source);
    every seventh document failed, and every one of batch src3."""
    ok = (F.col("doc_id") % 7 != 0) & F.coalesce(F.col("source") != "src3", F.lit(True))
    ext = F.element_at(F.array(*[F.lit(e) for e in FILE_EXTS]), (F.col("doc_id") % len(FILE_EXTS) + 1).cast("int"))
    return documents.select(
        F.col("source").alias("batch_id"), "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("filename"),
        ok.alias("success"),
        F.when(ok, F.lit("Text extracted successfully")).otherwise(F.lit("OCR failed: unreadable file")).alias("message"),
        F.when(ok, F.col("text")).otherwise(F.lit("")).alias("text"),
    )


def job_events(events: DataFrame) -> DataFrame:
    """Job event log: job = user; signup -> pending (insert), view/click ->
    processing, purchase -> completed (with result), error -> failed."""
    status = (F.when(F.col("event_type") == "signup", "pending")
              .when(F.col("event_type").isin("view", "click"), "processing")
              .when(F.col("event_type") == "purchase", "completed")
              .when(F.col("event_type") == "error", "failed")
              .otherwise(F.col("event_type")))
    return events.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.concat(F.lit("file_"), F.col("user_id").cast("string"), F.lit(".png")).alias("filename"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("result_json"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error in event "), F.col("event_id").cast("string"))).alias("error"),
    )


def requests(events: DataFrame) -> DataFrame:
    """Request log: client = user, path by event type ('view' hits /health)."""
    path = F.when(F.col("event_type") == "view", F.lit("/health")).otherwise(
        F.concat(F.lit("/api/"), F.col("event_type")))
    return events.select("event_id", F.col("user_id").cast("string").alias("client"),
                         F.col("ts").cast("timestamp").alias("ts"), path.alias("path"))


def request_headers(events: DataFrame) -> DataFrame:
    """Proxy headers per request, some missing or empty, for the client key."""
    u = F.col("user_id")
    ip = lambda a: F.concat(F.lit(a), (u % 250).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string"))
    xff = (F.when(u % 4 == 0, F.concat(F.lit(" "), ip("10.1."), F.lit(" , 172.16.0.1")))
           .when(u % 4 == 1, F.lit("")))
    real = F.when(u % 3 == 0, ip("10.2.")).when(u % 3 == 1, F.lit(""))
    host = F.when(u % 5 != 0, ip("192.168."))
    return events.select("event_id", xff.alias("x_forwarded_for"), real.alias("x_real_ip"), host.alias("host"))


# The five market segments of the TPC-H customer table, used
# as checkbox options of the rendered forms.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def invoice_texts(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Invoice text per order (doc_id = o_orderkey): header lines, one line
    per item ``<name> x<qty> @ $<price>`` in line order, then the total.
    Orders whose status is 'F' also name a vendor.  Labels and item lines vary
    with the order's key."""
    part, qty = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    items = lineitem.select(
        "l_orderkey",
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("part_"), part, F.lit(" x"), qty, F.lit(" @ $"), price))
        .otherwise(F.concat(F.lit("  part_"), part, F.lit("   "), qty, F.lit("  $"), price)).alias("_line"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("_o"))
    lines = items.groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "_line"))), lambda s: s["_line"]).alias("_items"))
    o = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(
        lines, orders.o_orderkey == lines.l_orderkey, "left")
    vendor = F.when(F.col("o_orderstatus") == "F",
                    F.concat(F.lit("Vendor: Store "), (F.col("o_custkey") % 50).cast("string")))
    label = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat_ws(
        "\n",
        F.concat(label("Invoice Number: ", "Invoice No: ", "INVOICE #"), F.lit("INV-"), F.col("o_orderkey").cast("string")),
        F.concat(label("Date: ", "Invoice Date: ", "Issue date:"), F.date_format("o_orderdate", "yyyy-MM-dd")),
        vendor,
        F.concat(label("Customer: ", "Bill To: ", "Client : "), F.col("c_name")),
        F.lit("Items:"),
        F.array_join(F.coalesce("_items", F.array().cast("array<string>")), "\n"),
        F.concat(label("Total: $", "Total Due: $", "Amount Due: $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def form_texts(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Form text per customer (doc_id = c_custkey) with a checkbox question:
    the customer's segment is ticked with 'x' (odd keys) or '☑' (even keys).
    Every fifth form asks the same question again, with another answer."""
    mark = F.when(F.col("c_custkey") % 2 == 0, F.lit("☑")).otherwise(F.lit("x"))
    options = [F.when(F.col("c_mktsegment") == s, F.concat(mark, F.lit(s))).otherwise(F.lit(s)) for s in SEGMENTS]
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("1. Name: "), F.col("c_name")),
        F.lit("2. Market segment:"),
        *options,
        F.concat(F.lit("3. Account balance: "), F.col("c_acctbal").cast("decimal(18,2)").cast("string")),
        F.concat(F.lit("4. Nation: "), F.coalesce("n_name", F.lit(""))),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("2. Market segment:\nxOTHER\nNONE\n☑ANY")),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


def text_images(docs: DataFrame, width: int = 16) -> DataFrame:
    """Gray images in the shape of Spark's ``image`` source: a document's characters are
    the pixels (code point mod 256) of rows of ``width``; what fills no row is left out."""
    rows = F.floor(F.length("text") / width).cast("int")
    codes = F.transform(F.split(F.substring("text", F.lit(1), rows * width), ""), lambda c: F.lpad(F.hex(F.ascii(c) % 256), 2, "0"))
    data = F.when(rows > 0, F.unhex(F.array_join(codes, "")))
    return docs.select(F.struct(F.col("doc_id").cast("string").alias("origin"), rows.alias("height"), F.lit(width).alias("width"),
                                F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data")).alias("image"))
