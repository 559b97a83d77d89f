"""Typed field extraction from document text (X1-X6), rule based.

The reference asks a hosted language model for these fields; here each
field is a named regular expression over the text, so extraction is a
native, row-local expression and reproducible.  Forms are arrays of lines; a
question owns the lines up to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import STRIP_RE, py_strip

NOT_FOUND = "Not found"
NOT_IN_DOCUMENTS = "Information not found in the documents."

# Labels that name each invoice field, at the start of a line and before ":" or "#".
INVOICE_LABELS = {
    "invoice_number": ("Invoice Number", "Invoice No.", "Invoice No", "Invoice ID", "Invoice"),
    "date": ("Date", "Invoice Date", "Issue Date", "Date of Issue"),
    "total": ("Total", "Total Amount", "Total Due", "Amount Due", "Grand Total", "Balance Due"),
    "vendor": ("Vendor", "Seller", "Supplier", "Sold By", "From"),
    "customer": ("Customer", "Bill To", "Billed To", "Client", "Sold To"),
}


def label_pattern(labels) -> str:
    """Pattern whose first group is the text after any of ``labels`` on its line."""
    any_of = "|".join(x.replace(".", r"\.").replace(" ", "[ \\t]+") for x in labels)
    return rf"(?im)^[ \t]*(?:{any_of})[ \t]*[:#]+[ \t]*(\S.*)$"


INVOICE_PATTERNS = {name: label_pattern(labels) for name, labels in INVOICE_LABELS.items()}
# name, quantity, price: "Pen x2 @ $3.50", "Pen 2 $3.50", "Pen x 2 @ 3"
ITEM_PATTERN = r"(?m)^[ \t]*([^\s:][^:\n]*?)[ \t]+x?[ \t]*([0-9]+)[ \t]+(?:@[ \t]*\$?|\$)[ \t]*([0-9][0-9.,]*)[ \t]*$"
QUESTION_RE = r"^[0-9]+\."
SELECTED_RE = "^(x[A-Z]|☑)"
FIELD_RE = r"^(?:[0-9]+\. *)?([^:]+): *(.*)$"


def _field(text: Column, pattern: str) -> Column:
    v = py_strip(F.regexp_extract(text, pattern, 1))
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(NOT_FOUND))


def invoice_fields(df: DataFrame, text: str = "text", patterns: dict[str, str] | None = None,
                   item_pattern: str = ITEM_PATTERN) -> DataFrame:
    """invoice_number, date, total, vendor, customer ("Not found" when
    missing) and items ARRAY<STRUCT<name, quantity, price>>.  ``patterns`` gives
    one pattern per field (first group), ``item_pattern`` one with three groups."""
    t = F.col(text)
    items = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(item_pattern), i + 1).alias(n)
                           for i, n in enumerate(("name", "quantity", "price"))])
    return df.withColumns({k: _field(t, p) for k, p in (patterns or INVOICE_PATTERNS).items()}).withColumn("items", items)


def invoice_items(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """X3 long form: one row per item (key, item_no 1-based, name, quantity, price)."""
    f = invoice_fields(df.select(key, text), text)
    return f.select(key, F.posexplode("items").alias("_i", "_it")).select(
        key, (F.col("_i") + 1).cast("int").alias("item_no"),
        F.col("_it.name").alias("name"), F.col("_it.quantity").alias("quantity"), F.col("_it.price").alias("price"))


def _questions(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, lines (stripped) and questions ARRAY<STRUCT<pos, question, ticked>>:
    a numbered line and the options ticked before the next one.  Row-local."""
    d = df.select(key, F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, STRIP_RE, "")).alias("lines"))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(QUESTION_RE))
    d = d.withColumn("_q", starts)

    def ticked(p, j):
        end = F.coalesce(F.get("_q", j + 1), F.size("lines"))
        options = F.filter(F.slice("lines", p + 2, end - p - 1), lambda x: x.rlike(SELECTED_RE))
        return F.struct(p.alias("pos"), F.get("lines", p).alias("question"),
                        F.transform(options, lambda x: F.substr(x, F.lit(2))).alias("ticked"))

    return d.select(key, "lines", F.transform("_q", ticked).alias("questions"))


def checkbox_answers(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every numbered question, the options marked 'x' or '☑' (marker
    removed), in order, joined by ', '.  A question is its line, so one that is
    asked twice is answered twice.  Output: key, line_no (from 1), question, answer."""
    q = _questions(df, key, text).select(key, F.inline("questions"))
    return q.where(F.size("ticked") > 0).select(
        key, (F.col("pos") + 1).cast("int").alias("line_no"), "question", F.array_join("ticked", ", ").alias("answer"))


def form_fields(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``Field: value`` lines; a question with an empty value takes its
    ticked options (X1).  Output: key, line_no (from 1), field, value."""
    d = _questions(df, key, text)
    answers = F.map_from_arrays(F.col("questions.pos"), F.transform("questions", lambda q: F.array_join(q["ticked"], ", ")))
    ln = d.select(key, answers.alias("_a"), F.posexplode("lines").alias("pos", "line")).where(F.col("line").rlike(FIELD_RE))
    value = py_strip(F.regexp_extract("line", FIELD_RE, 2))
    return ln.select(key, (F.col("pos") + 1).cast("int").alias("line_no"), py_strip(F.regexp_extract("line", FIELD_RE, 1)).alias("field"),
                     F.when(value == "", F.coalesce(F.try_element_at("_a", F.col("pos")), F.lit(""))).otherwise(value).alias("value"))


def invoice_long(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Invoice scalar fields as (key, field, value) rows."""
    f = invoice_fields(df.select(key, text), text)
    names = list(INVOICE_PATTERNS)
    return f.select(key, F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value"))
                                            for n in names])))


def dispatch_fields(df: DataFrame, key: str = "doc_id", text: str = "text",
                    field_type: str = "field_type") -> DataFrame:
    """X5: 'form' rows go to the form extractor, everything else (invoice,
    auto, unknown) to the invoice extractor; two filtered branches, one union."""
    is_form = F.col(field_type) == "form"
    forms = form_fields(df.filter(is_form), key, text).drop("line_no")
    inv = invoice_long(df.filter(~is_form | F.col(field_type).isNull()), key, text)
    return forms.withColumn("extractor", F.lit("form")).unionByName(inv.withColumn("extractor", F.lit("invoice")))


def render_fields(df: DataFrame, fields: list[str] | None = None, answer: str = "answer",
                  raw: str = "fields") -> Column:
    """``answer`` if present, else ``fields`` text, else one ``key: value``
    line per field, list fields as ``key:`` followed by ``  - item`` lines
    (struct items rendered as JSON)."""
    cols = df.columns
    names = fields or [c for c in cols if c not in (answer, raw)]
    parts = []
    for n in names:
        dt = df.schema[n].dataType
        if dt.typeName() == "array":
            et = dt.elementType
            item = (lambda x: F.to_json(x)) if et.typeName() in ("struct", "map", "array") else (lambda x: x.cast("string"))
            bullets = F.array_join(F.transform(F.col(n), lambda x: F.concat(F.lit("  - "), item(x))), "\n")
            parts.append(F.when(F.size(F.col(n)) > 0, F.concat(F.lit(f"{n}:\n"), bullets)).otherwise(F.lit(f"{n}:")))
        else:
            parts.append(F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("None"))))
    generic = F.concat_ws("\n", *parts)
    out = generic
    if raw in cols:
        out = F.coalesce(F.col(raw), out)
    if answer in cols:
        out = F.coalesce(F.col(answer), out)
    return out
