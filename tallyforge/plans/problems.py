"""The queries of the general problems p3, p5 and p6, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.bitmap_history import attribute_history, valid_at, with_values
from tallyforge.operators.orphans import OrphanCheck
from tallyforge.operators import unit_graph
from tallyforge.operators.unit_graph import in_thousandths, normalised_quantities
from tallyforge.storage import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return attribute_history(table(spark, sf_dir, "receipt_edit_history")).select(
        "entity_type", "entity_id", "field_name", "version_no", text("valid_from"), text("valid_to")
    )


def p3_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values in force at the end of 2023."""
    changes = table(spark, sf_dir, "receipt_edit_history")
    return valid_at(with_values(attribute_history(changes), changes), "2023-12-31 23:59:59")


def _orphans(spark: SparkSession, sf_dir: str) -> OrphanCheck:
    return OrphanCheck({name: table(spark, sf_dir, name) for name in ("receipts", "line_items")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).references()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).counts()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_thousandths(normalised_quantities(table(spark, sf_dir, "line_items")))


P5_SQL = """
WITH refs AS (
  SELECT 'line_items' AS ref_table, 'receipt_id' AS ref_field, l.id AS row_id, l.created_at, t.id AS target,
         t.deleted_at AS gone, t.created_at AS born
  FROM line_items l LEFT JOIN receipts t ON t.id = l.receipt_id WHERE l.receipt_id IS NOT NULL
  UNION ALL
  SELECT 'line_items', 'parent_line_item_id', l.id, l.created_at, t.id, t.deleted_at, t.created_at
  FROM line_items l LEFT JOIN line_items t ON t.id = l.parent_line_item_id WHERE l.parent_line_item_id IS NOT NULL
  UNION ALL
  SELECT 'receipts', 'duplicate_of_receipt_id', r.id, r.created_at, t.id, t.deleted_at, t.created_at
  FROM receipts r LEFT JOIN receipts t ON t.id = r.duplicate_of_receipt_id WHERE r.duplicate_of_receipt_id IS NOT NULL),
found AS (
  SELECT ref_table, ref_field, row_id, strftime(created_at, '%Y-%m') AS ref_month,
         CASE WHEN target IS NULL THEN 'missing' WHEN gone <= created_at THEN 'deleted'
              WHEN born > created_at THEN 'late' END AS ref_kind
  FROM refs)
"""

P3_CTES = r"""
WITH typed AS (
  SELECT *, CASE WHEN v IS NULL THEN '0'
      WHEN field_name IN ('totalAmount', 'taxAmount', 'totalPrice', 'amount', 'pricePerUnit')
        THEN coalesce('n' || CAST(TRY_CAST(trim(v) AS DECIMAL(28, 10)) AS VARCHAR), 't' || v)
      WHEN field_name = 'transactionDate'
        THEN coalesce('i' || CAST(epoch_us(TRY_CAST(replace(replace(v, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS VARCHAR), 't' || v)
      ELSE 't' || trim(regexp_replace(v, '\s+', ' ', 'g')) END AS k
  FROM (SELECT entity_type, entity_id, field_name, id, changed_at, old_value AS v, -1 AS d FROM receipt_edit_history
        UNION ALL SELECT entity_type, entity_id, field_name, id, changed_at, new_value, 1 FROM receipt_edit_history)),
paired AS (
  SELECT entity_type, entity_id, field_name, changed_at, id, max(k) FILTER (d = -1) AS old_k, max(k) FILTER (d = 1) AS new_k,
         max(v) FILTER (d = -1) AS old_v, max(v) FILTER (d = 1) AS new_v FROM typed GROUP BY ALL),
edges AS (SELECT DISTINCT entity_type, entity_id, field_name, changed_at, old_k, new_k FROM paired),
ends AS (
  SELECT entity_type, entity_id, field_name, changed_at, k, sum(d) AS d FROM (
    SELECT entity_type, entity_id, field_name, changed_at, old_k AS k, -1 AS d FROM edges
    UNION ALL SELECT entity_type, entity_id, field_name, changed_at, new_k, 1 FROM edges) GROUP BY ALL),
seconds AS (
  SELECT entity_type, entity_id, field_name, changed_at, arg_max(k, d) AS after_k, arg_min(k, d) AS before_k
  FROM ends GROUP BY ALL),
marked AS (
  SELECT *, lag(after_k) OVER g AS prev_k FROM seconds
  WINDOW g AS (PARTITION BY entity_type, entity_id, field_name ORDER BY changed_at)),
starts AS (
  SELECT entity_type, entity_id, field_name, changed_at, after_k AS k, changed_at AS since FROM marked WHERE after_k <> coalesce(prev_k, before_k)
  UNION ALL SELECT entity_type, entity_id, field_name, TIMESTAMP '0001-01-01 00:00:00', arg_min(before_k, changed_at), min(changed_at) FROM seconds GROUP BY ALL)
"""

P3_SQL = P3_CTES + """
SELECT entity_type, entity_id, field_name, CAST(row_number() OVER g AS INTEGER) AS version_no,
       CASE WHEN changed_at > TIMESTAMP '0001-01-01 00:00:00' THEN strftime(changed_at, '%Y-%m-%d %H:%M:%S') ELSE '' END AS valid_from,
       coalesce(strftime(lead(changed_at) OVER g, '%Y-%m-%d %H:%M:%S'), '') AS valid_to
FROM starts WINDOW g AS (PARTITION BY entity_type, entity_id, field_name ORDER BY changed_at)
"""

P3_AS_OF_SQL = P3_CTES + """,
versions AS (
  SELECT *, CAST(row_number() OVER g AS INTEGER) AS version_no, lead(changed_at) OVER g AS ends FROM starts
  WINDOW g AS (PARTITION BY entity_type, entity_id, field_name ORDER BY changed_at)),
news AS (SELECT entity_type, entity_id, field_name, changed_at AS since, new_k AS k, arg_max(new_v, id) AS t FROM paired GROUP BY ALL),
olds AS (SELECT entity_type, entity_id, field_name, changed_at AS since, old_k AS k, arg_min(old_v, id) AS t FROM paired GROUP BY ALL)
SELECT v.entity_type, v.entity_id, v.field_name, v.version_no, CASE WHEN v.version_no = 1 THEN o.t ELSE n.t END AS value
FROM versions v LEFT JOIN news n USING (entity_type, entity_id, field_name, since, k) LEFT JOIN olds o USING (entity_type, entity_id, field_name, since, k)
WHERE v.changed_at <= TIMESTAMP '2023-12-31 23:59:59' AND (v.ends IS NULL OR v.ends > TIMESTAMP '2023-12-31 23:59:59')
"""


def p6_sql() -> str:
    """The same with capture groups in place of look-around, and exact integers in place of divisions."""
    found = unit_graph.default_graph().to_canonical(unit_graph.CANONICAL)
    spellings = [(s, base, f.decimal()) for unit, (base, f) in found.items() for s in unit_graph.spelling_list(unit_graph.SPELLINGS.get(unit, unit))]
    units = ", ".join(f"('{s}', '{base}', CAST({f} AS DECIMAL(17, 13)))" for s, base, f in spellings)
    words = "|".join(sorted((s for s, _, _ in spellings if s != '"'), key=len, reverse=True))
    ounces = r"(?: ?(\d+(?:\.\d+)?) ?(oz|ounces?)(?:[^\p{L}\d]|$))"
    measure = rf"(?:^|[^\p{{L}}\d./-])(?:(\d+) ?x ?)?(\d+ \d+/\d+|\d+/\d+|\d+(?:\.\d+)?) ?(?:({words})(?:{ounces}|[^\p{{L}}\d/-]|$)|(\"){ounces}?)"
    blank = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]"
    empty = rf"regexp_full_match(coalesce(unit, ''), '(?:{blank}|\x{{feff}})*')"
    ounce = found["oz"][1].decimal()
    return rf"""
WITH units(spelling, base_unit, factor) AS (VALUES {units}),
products AS (
  SELECT id, amount, price_per_unit, total_price, lower(CASE WHEN {empty} THEN description ELSE unit END) AS t FROM line_items
  WHERE item_type = 'product' AND (NOT {empty} OR regexp_matches(description, '[0-9½¼¾]'))),
dots AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(t, '½', ' 1/2'), '¼', ' 1/4'), '¾', ' 3/4'), '[×*]', 'x', 'g'),
    '(\d),(\d)', '\1.\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g') AS d FROM products),
texts AS (SELECT id, amount, price_per_unit, total_price, trim(regexp_replace(replace(replace(d, '.', ' '), chr(1), '.'), '{blank}+', ' ', 'g')) AS text FROM dots),
found AS (
  SELECT *, regexp_matches(text, '\d') AS measured, regexp_extract(text, '{measure}', ['times', 'size', 'word', 'oz', 'ozword', 'inch', 'oz2', 'ozword2']) AS f FROM texts),
read AS (
  SELECT *, CASE WHEN measured THEN f.word || f.inch ELSE text END AS spelling,
    CASE WHEN contains(f.size, '/') THEN coalesce(TRY_CAST(regexp_extract(f.size, '^(\d+) \d+/', 1) AS DECIMAL(15, 8)), 0)
      + CAST(TRY_CAST(regexp_extract(f.size, '(\d+)/\d+$', 1) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(f.size, '/(\d+)$', 1) AS DOUBLE), 0) AS DECIMAL(15, 8))
      ELSE TRY_CAST(f.size AS DECIMAL(15, 8)) END AS size FROM found),
sized AS (
  SELECT r.*, u.base_unit, CASE WHEN measured THEN CAST((CAST(coalesce(CAST(size AS DECIMAL(15, 8)), 1) * factor AS DECIMAL(26, 14))
      + CAST(coalesce(TRY_CAST(nullif(f.oz || f.oz2, '') AS DECIMAL(15, 8)), 0) * CAST({ounce} AS DECIMAL(17, 13)) AS DECIMAL(26, 14)))
      * coalesce(TRY_CAST(f.times AS DECIMAL(6, 0)), 1) AS DECIMAL(22, 14)) ELSE CAST(factor AS DECIMAL(22, 14)) END AS content,
    coalesce(abs(amount * price_per_unit - total_price) > 0.01 AND abs(amount * price_per_unit - total_price * 1000) <= 10, false) AS thousandth
  FROM read r JOIN units u ON u.spelling = r.spelling),
done AS (
  SELECT *, CASE WHEN thousandth THEN CAST(round(amount, 0) AS BIGINT)
    ELSE CAST(round(coalesce(amount, CASE WHEN measured THEN CAST(1 AS DECIMAL(10, 3)) END) * content * 1000, 0) AS BIGINT) END AS quantity_milli,
    CAST(price_per_unit * 10000 AS HUGEINT) AS p, CAST(content * 100000000000000 AS HUGEINT) AS c FROM sized)
SELECT id AS line_item_id, base_unit, quantity_milli, CAST(coalesce(CASE WHEN thousandth THEN (p + 50) // 100
  ELSE (2 * p * 1000000000000 + c) // (2 * nullif(c, 0)) END, -1) AS BIGINT) AS price_cents FROM done WHERE quantity_milli IS NOT NULL
"""


def p6_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each priced line would be in pounds, by its own spelling of a unit of mass."""
    lines = table(spark, sf_dir, "line_items").where("unit IS NOT NULL").select("id", "unit", "amount").withColumn("target", F.lit("lb"))
    found = unit_graph.converted(lines, "amount", F.col("unit"), F.col("target"))
    return found.where("converted IS NOT NULL").select("id", F.round("converted", 6).alias("pounds"))


def p6_conversions_sql() -> str:
    """From every spelling of a unit of mass to pounds, by grams."""
    found = unit_graph.default_graph().to_canonical(unit_graph.CANONICAL)
    kilos = [(s, f.scale) for unit, (base, f) in found.items() if base == "kg" for s in unit_graph.spelling_list(unit_graph.SPELLINGS.get(unit, unit))]
    rows = ", ".join(f"('{s}', CAST({float(k)!r} AS DOUBLE))" for s, k in kilos)
    return f"""WITH m(unit, kilos) AS (VALUES {rows})
SELECT l.id, round(CAST(l.amount AS DOUBLE) * m.kilos / 0.45359237, 6) AS pounds FROM line_items l JOIN m ON m.unit = trim(replace(lower(l.unit), '.', '')) WHERE l.amount IS NOT NULL"""


def queries() -> dict:
    return {"p3_found": p3_found, "p3_as_of": p3_as_of, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_conversions": p6_conversions}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_SQL,
        "p3_as_of": P3_AS_OF_SQL,
        "p6_found": p6_sql(),
        "p6_conversions": p6_conversions_sql(),
        "p5_found": P5_SQL + "SELECT * FROM found WHERE ref_kind IS NOT NULL",
        "p5_report": P5_SQL
        + """SELECT ref_table, ref_field, ref_month, ref_kind, count(*) AS n_refs FROM found
             WHERE ref_kind IS NOT NULL GROUP BY ALL""",
    }
