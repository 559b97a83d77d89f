"""Field-extraction queries over invoice texts (orders) and form texts
(customers) (X1-X6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import fields as X
from scriptorium.plans.registry import register
from scriptorium.session import read_table, spread
from scriptorium.sources import derived as D


def invoices(spark, sf):
    return D.invoice_texts(read_table(spark, sf, "orders"), read_table(spark, sf, "customer"),
                           read_table(spark, sf, "lineitem"))


def forms(spark, sf):
    return D.form_texts(spread(read_table(spark, sf, "customer")), read_table(spark, sf, "nation"))


# The oracles state what the rendered texts say, from the base tables; they share
# no pattern with the extractors.
SQL_INVOICES = """
itl AS (SELECT l_orderkey, list({'name': 'part_' || CAST(l_partkey AS VARCHAR),
                                 'quantity': CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR),
                                 'price': CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)}
                                ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS items
        FROM lineitem GROUP BY l_orderkey),
inv AS (SELECT o.o_orderkey AS doc_id, 'INV-' || CAST(o.o_orderkey AS VARCHAR) AS invoice_number,
               strftime(o.o_orderdate, '%Y-%m-%d') AS date, '$' || CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total,
               CASE WHEN o.o_orderstatus = 'F' THEN 'Store ' || CAST(o.o_custkey % 50 AS VARCHAR) ELSE 'Not found' END AS vendor,
               coalesce(c.c_name, 'Not found') AS customer, coalesce(itl.items, []) AS items
        FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN itl ON itl.l_orderkey = o.o_orderkey)"""

SQL_FORMS = """
ff AS (SELECT c.c_custkey AS doc_id, 1 AS line_no, 'Name' AS field, c.c_name AS value FROM customer c
       UNION ALL SELECT c_custkey, 2, 'Market segment',
                        CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN c_mktsegment ELSE '' END
                 FROM customer
       UNION ALL SELECT c_custkey, 8, 'Account balance', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM customer
       UNION ALL SELECT c_custkey, 9, 'Nation', coalesce(n_name, '') FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT c_custkey, 10, 'Market segment', 'OTHER, ANY' FROM customer WHERE c_custkey % 5 = 0)"""


@register("invoice_fields", f"""WITH {SQL_INVOICES}
SELECT doc_id, invoice_number, date, total, vendor, customer, CAST(len(items) AS INTEGER) AS n_items FROM inv""")
def invoice_fields(spark, sf):
    """Invoice fields of every order's invoice text, under varying labels."""
    f = X.invoice_fields(invoices(spark, sf))
    return f.select("doc_id", *X.INVOICE_PATTERNS, F.size("items").alias("n_items"))


@register("invoice_items", f"""WITH {SQL_INVOICES}
SELECT doc_id, CAST(i AS INTEGER) AS item_no, items[i].name AS name, items[i].quantity AS quantity, items[i].price AS price
FROM (SELECT doc_id, items, unnest(generate_series(1, len(items))) AS i FROM inv)""")
def invoice_items(spark, sf):
    """X3 long form: extracted line items."""
    return X.invoice_items(invoices(spark, sf))


@register("checkbox_fields", f"""WITH {SQL_FORMS}
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, '2. Market segment:' AS question, value AS answer FROM ff
WHERE field = 'Market segment' AND value <> ''""")
def checkbox_fields(spark, sf):
    """Ticked options of every checkbox question in the customer forms."""
    return X.checkbox_answers(forms(spark, sf))


@register("form_fields", f"WITH {SQL_FORMS} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, field, value FROM ff")
def form_fields(spark, sf):
    """field/value pairs of every customer form, checkbox aware."""
    return X.form_fields(forms(spark, sf))


@register("field_dispatch", f"""WITH {SQL_INVOICES}, {SQL_FORMS}
SELECT 'form-' || CAST(doc_id AS VARCHAR) AS doc_id, field, value, 'form' AS extractor FROM ff
UNION ALL
SELECT 'invoice-' || CAST(doc_id AS VARCHAR), f.field, f.value, 'invoice' FROM (
  SELECT doc_id, unnest([{{'field': 'invoice_number', 'value': invoice_number}}, {{'field': 'date', 'value': date}},
                         {{'field': 'total', 'value': total}}, {{'field': 'vendor', 'value': vendor}},
                         {{'field': 'customer', 'value': customer}}]) AS f FROM inv)""")
def field_dispatch(spark, sf):
    """Forms routed to the form extractor, invoices (and 'auto') to the invoice extractor."""
    f = forms(spark, sf).select(F.concat(F.lit("form-"), F.col("doc_id").cast("string")).alias("doc_id"), "text",
                                F.lit("form").alias("field_type"))
    i = invoices(spark, sf).select(F.concat(F.lit("invoice-"), F.col("doc_id").cast("string")).alias("doc_id"), "text",
                                   F.when(F.col("doc_id") % 2 == 0, "invoice").otherwise("auto").alias("field_type"))
    return X.dispatch_fields(f.unionByName(i))


@register("render_fields", f"""WITH {SQL_INVOICES}
SELECT doc_id, concat_ws(chr(10), 'invoice_number: ' || invoice_number, 'date: ' || date, 'total: ' || total,
       'vendor: ' || vendor, 'customer: ' || customer,
       CASE WHEN len(items) > 0 THEN 'items:' || chr(10) || array_to_string(list_transform(items,
            lambda x: '  - {{"name":' || to_json(x.name) || ',"quantity":' || to_json(x.quantity) || ',"price":' || to_json(x.price) || '}}'), chr(10))
            ELSE 'items:' END) AS text
FROM inv""")
def render_fields(spark, sf):
    """Extracted invoice fields rendered as ``key: value`` lines."""
    f = X.invoice_fields(invoices(spark, sf))
    f = f.select("doc_id", *X.INVOICE_PATTERNS, "items")
    return f.select("doc_id", X.render_fields(f, list(X.INVOICE_PATTERNS) + ["items"]).alias("text"))
