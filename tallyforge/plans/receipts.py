"""Queries of the general operators over the receipt tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import numbers, ocr, text
from tallyforge.operators import boxes, edits, receipt_duplicates, state_changes, text_lines, upload_stats
from tallyforge.sources import exports
from tallyforge.storage import table
from tallyforge.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the same result in SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# --- statistics of uploads ---------------------------------------------------------------------

STATS = """
stats AS (
  SELECT u.id AS upload_id, u.user_id, u.upload_number,
         coalesce(nullif(u.original_file_name, ''), nullif(regexp_extract(u.original_image_url, '[^/]*$'), ''), 'unknown.jpg') AS file_name,
         u.status, coalesce(u.has_receipts = 1, false) AS has_receipts, u.created_at, u.updated_at,
         CAST(sum(CASE WHEN r.deleted_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS total_receipts,
         CAST(count(*) FILTER (r.status = 'processed' AND r.deleted_at IS NULL) AS BIGINT) AS successful,
         count(*) FILTER (r.status IN ('failed', 'unreadable') AND r.deleted_at IS NULL) AS failed,
         count(*) FILTER (r.status = 'pending' AND r.deleted_at IS NULL) AS processing,
         count(*) FILTER (r.review_status = 'needs_review' AND r.deleted_at IS NULL) AS needs_review,
         count(*) FILTER (r.edited_at IS NOT NULL AND r.deleted_at IS NULL) AS edited,
         count(*) FILTER (r.status = 'rate_limited' AND r.deleted_at IS NULL) AS rate_limited,
         CAST(coalesce(sum(r.total_amount) FILTER (r.deleted_at IS NULL), 0) AS DECIMAL(23, 4)) AS total_value,
         CASE WHEN count(DISTINCT r.currency) FILTER (r.deleted_at IS NULL) = 1 THEN min(r.currency) FILTER (r.deleted_at IS NULL) END AS currency,
         count(DISTINCT r.currency) FILTER (r.deleted_at IS NULL) > 1 AS mixed_currencies
  FROM receipt_uploads u LEFT JOIN receipts r ON r.upload_id = u.id
  GROUP BY u.id, u.user_id, u.upload_number, u.original_file_name, u.original_image_url, u.status, u.has_receipts, u.created_at, u.updated_at)
"""
PAGE = """SELECT * EXCLUDE (place), place, total > 50 AS has_more FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, upload_id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM stats)
  WHERE place <= 50"""


@query(f"WITH {STATS} {PAGE}")
def uploads_page(spark: SparkSession, d: str) -> DataFrame:
    u, r = _t(spark, d, "receipt_uploads", "receipts")
    return upload_stats.page(upload_stats.upload_statistics(u, r))


@query(
    f"WITH {STATS} SELECT s.* REPLACE (CASE WHEN x.n IS NULL THEN 0 ELSE total_receipts END AS total_receipts) FROM stats s "
    "LEFT JOIN (SELECT upload_id, count(*) AS n FROM receipts GROUP BY 1) x ON x.upload_id = s.upload_id"
)
def uploads_statistics_fixed(spark: SparkSession, d: str) -> DataFrame:
    u, r = _t(spark, d, "receipt_uploads", "receipts")
    return upload_stats.upload_statistics(u, r, empty_counts_one=False)


EXPORT_STATS = """
export_stats AS (
  SELECT u.id AS upload_id, u.user_id, coalesce(nullif(regexp_extract(u.original_image_url, '[^/]*$'), ''), 'unknown.jpg') AS file_name, u.status,
         count(r.id) AS total_detected, count(*) FILTER (r.status = 'processed') AS successful,
         count(*) FILTER (r.status IN ('failed', 'unreadable')) AS failed, count(*) FILTER (r.status = 'pending') AS processing, u.created_at, u.updated_at
  FROM receipt_uploads u LEFT JOIN receipts r ON r.upload_id = u.id GROUP BY u.id, u.user_id, u.original_image_url, u.status, u.created_at, u.updated_at)
"""


@query(f"WITH {EXPORT_STATS} SELECT * FROM export_stats")
def uploads_export_stats(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.export_statistics(*_t(spark, d, "receipt_uploads", "receipts"))


@query("""SELECT upload_id, bool_and(coalesce(status = 'processed', false)) AS all_processed,
  coalesce(bool_and(coalesce(status = 'processed', false)) FILTER (deleted_at IS NULL), true) AS all_live_processed
  FROM receipts WHERE upload_id IS NOT NULL GROUP BY 1""")
def upload_all_states(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.all_states(table(spark, d, "receipts"))


@query("""SELECT r.id AS receipt_id, u.user_id, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY r.id) AS INTEGER) AS number
  FROM receipts r JOIN receipt_uploads u ON u.id = r.upload_id""")
def receipt_numbering(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.receipt_numbers(*_t(spark, d, "receipt_uploads", "receipts"))


@query("""SELECT s.id AS user_id, coalesce(max(u.upload_number), 0) + 1 AS next_number FROM users s LEFT JOIN receipt_uploads u ON u.user_id = s.id GROUP BY 1""")
def next_numbers(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.next_numbers(*_t(spark, d, "users", "receipt_uploads"))


@query("""SELECT u.id, u.user_id, CAST(coalesce(m.n, 0) + row_number() OVER (PARTITION BY u.user_id ORDER BY u.id) AS INTEGER) AS upload_number
  FROM receipt_uploads u LEFT JOIN (SELECT user_id, max(upload_number) AS n FROM receipt_uploads WHERE batch_no = 0 GROUP BY 1) m ON m.user_id = u.user_id
  WHERE u.batch_no > 0""")
def insert_numbering(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "receipt_uploads")
    return upload_stats.numbered_inserts(u.where("batch_no > 0").select("id", "user_id"), u.where("batch_no = 0"))


@query("""SELECT receipt_id, category, n FROM (
  SELECT receipt_id, category, count(*) AS n, row_number() OVER (PARTITION BY receipt_id ORDER BY count(*) DESC, min(id)) AS p
  FROM line_items WHERE category <> '' AND item_type NOT IN ('discount', 'tax') AND receipt_id IS NOT NULL GROUP BY receipt_id, category) WHERE p = 1""")
def majority_category(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.majority_category(table(spark, d, "line_items"))


@query("""SELECT value, count(*) AS n_rows FROM (SELECT category AS value FROM receipts UNION ALL SELECT category FROM line_items UNION ALL SELECT unnest(keywords) FROM receipts)
  WHERE value IS NOT NULL AND value NOT IN (SELECT category_id FROM spend_categories) GROUP BY 1""")
def category_conformance(spark: SparkSession, d: str) -> DataFrame:
    """Categories and keywords that are no category of the list; all categories in the data are, keywords are not."""
    r, li, c = _t(spark, d, "receipts", "line_items", "spend_categories")
    used = r.select(F.col("category").alias("value")).unionAll(li.select("category")).unionAll(r.select(F.explode("keywords")))
    return upload_stats.not_listed(used, "value", c.select("category_id"))


@query("""SELECT group_no, string_agg(category_id || ': ' || category_name, chr(10) ORDER BY category_id) AS listing FROM spend_categories GROUP BY 1""")
def category_listing(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "spend_categories")
    entry = F.array_sort(F.collect_list(F.struct("category_id", "category_name")))
    line = F.transform(entry, lambda x: F.concat(x["category_id"], F.lit(": "), x["category_name"]))
    return c.groupBy("group_no").agg(F.array_join(line, "\n").alias("listing"))


@query("""SELECT r.id AS receipt_id, count(l.id) AS n_items, CAST(coalesce(sum(coalesce(l.total_price, 0)), 0) AS DECIMAL(23, 4)) AS line_sum,
  CAST(abs(coalesce(sum(coalesce(l.total_price, 0)), 0) - r.total_amount) AS DECIMAL(23, 4)) AS apart, round(coalesce(avg(CAST(l.confidence AS DOUBLE)), 0), 6) AS mean_confidence
  FROM receipts r LEFT JOIN line_items l ON l.receipt_id = r.id GROUP BY r.id, r.total_amount""")
def receipt_sum_check(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.sum_check(*_t(spark, d, "receipts", "line_items")).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("""SELECT receipt_id, count(*) FILTER (item_type = 'product') AS n_products, count(*) FILTER (item_type = 'product' AND extraction_flag = 'ocr_mismatch') AS n_flagged,
  bool_or(coalesce(item_type IN ('discount', 'refund'), false)) AS has_discount,
  coalesce(round(count(*) FILTER (item_type = 'product' AND extraction_flag = 'ocr_mismatch') / CAST(nullif(count(*) FILTER (item_type = 'product'), 0) AS DOUBLE), 6), 0) AS ratio,
  count(*) FILTER (item_type = 'product') >= 3 AND coalesce(round(count(*) FILTER (item_type = 'product' AND extraction_flag = 'ocr_mismatch') / CAST(nullif(count(*) FILTER (item_type = 'product'), 0) AS DOUBLE), 6), 0) >= 0.8 AS unreliable
  FROM line_items WHERE receipt_id IS NOT NULL GROUP BY 1""")
def receipt_line_flags(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.line_flags(table(spark, d, "line_items"))


@query("""SELECT c.id, p.id AS parent_id, p.description AS parent_description, p.total_price AS parent_price FROM line_items c LEFT JOIN line_items p ON p.id = c.parent_line_item_id
  WHERE c.parent_line_item_id IS NOT NULL""")
def lines_with_parents(spark: SparkSession, d: str) -> DataFrame:
    return upload_stats.lines_with_parents(table(spark, d, "line_items"))


@query("""SELECT id, upload_id, CAST((row_number() OVER (PARTITION BY upload_id ORDER BY id) - 1) * 12 AS INTEGER) AS delay FROM receipts WHERE status = 'rate_limited'""")
def staggered_retries(spark: SparkSession, d: str) -> DataFrame:
    waiting = table(spark, d, "receipts").where("status = 'rate_limited'").select("id", "upload_id")
    return upload_stats.staggered(waiting, "upload_id", "id", 12)


# --- exports ------------------------------------------------------------------------------------

SETTINGS = """
settings AS (
  SELECT id AS user_id, coalesce(export_settings.decimal_separator, '.') AS ds, coalesce(export_settings.amount_format, 'decimal') AS af,
         coalesce(export_settings.date_format, 'YYYY-MM-DD') AS df, coalesce(export_settings.include_currency, true) AS ic,
         coalesce(export_settings.include_header, true) AS ih, CASE WHEN coalesce(export_settings.decimal_separator, '.') = ',' THEN ';' ELSE ',' END AS sep FROM users)
"""


def _amount_sql(c: str) -> str:
    two = f"CAST(CAST(round({c}, 2) AS DECIMAL(18, 2)) AS VARCHAR)"
    return (
        f"coalesce(CASE WHEN af = 'cents' THEN CAST(CAST(round({c} * 100, 0) AS BIGINT) AS VARCHAR) WHEN af = 'integer4dp' THEN CAST(CAST(round({c} * 10000, 0) AS BIGINT) AS VARCHAR) "
        f"WHEN ds = ',' THEN replace({two}, '.', ',') ELSE {two} END, '')"
    )


def _date_sql(c: str) -> str:
    return f"coalesce(CASE WHEN df = 'DD.MM.YYYY' THEN strftime({c}, '%d.%m.%Y') WHEN df = 'MM/DD/YYYY' THEN strftime({c}, '%m/%d/%Y') ELSE strftime({c}, '%Y-%m-%d') END, '')"


def _quote_sql(c: str) -> str:
    return f"'\"' || replace(coalesce(CAST({c} AS VARCHAR), ''), '\"', '\"\"') || '\"'"


@query("""SELECT receipt_id, id AS item_id, description, total_price, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY total_price DESC, id) AS place FROM line_items
  WHERE deleted_at IS NULL AND total_price IS NOT NULL AND receipt_id IS NOT NULL) WHERE place <= 5""")
def top5_items(spark: SparkSession, d: str) -> DataFrame:
    return exports.top_items(table(spark, d, "line_items"))


@query(f"""WITH {SETTINGS},
tops AS (
  SELECT receipt_id, array_agg(description ORDER BY total_price DESC, id) AS ds_, array_agg(total_price ORDER BY total_price DESC, id) AS ps FROM (
    SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY total_price DESC, id) AS place FROM line_items WHERE deleted_at IS NULL AND total_price IS NOT NULL)
  WHERE place <= 5 GROUP BY 1),
named AS (
  SELECT r.id, string_agg(coalesce(t.ds_[i], 'null') || '(' || {_amount_sql("t.ps[i]")} || coalesce(r.currency, '') || ')', ' | ' ORDER BY i) AS names
  FROM receipts r JOIN receipt_uploads u ON u.id = r.upload_id JOIN settings USING (user_id) JOIN tops t ON t.receipt_id = r.id, range(1, 6) x(i) WHERE i <= len(t.ps) GROUP BY 1),
counts AS (SELECT receipt_id, count(*) FILTER (deleted_at IS NULL) AS n FROM line_items GROUP BY 1)
SELECT u.user_id, r.id AS receipt_id, r.id || sep || r.upload_id || sep || {_quote_sql("r.store_name")} || sep || {_amount_sql("r.total_amount")} || sep || {_amount_sql("r.tax_amount")} || sep
  || CASE WHEN ic THEN {_quote_sql("r.currency")} || sep ELSE '' END || {_quote_sql(_date_sql("r.transaction_date"))} || sep || {_quote_sql("r.status")} || sep
  || {_quote_sql("coalesce(r.review_status, 'not_required')")} || sep || {_quote_sql("array_to_string(r.keywords, '; ')")} || sep || {_quote_sql("coalesce(c.n, 0)")} || sep || {_quote_sql("coalesce(n.names, '')")} AS line
FROM receipts r JOIN receipt_uploads u ON u.id = r.upload_id JOIN settings USING (user_id) LEFT JOIN counts c ON c.receipt_id = r.id LEFT JOIN named n ON n.id = r.id""")
def receipts_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.receipt_rows(*_t(spark, d, "receipts", "receipt_uploads", "users", "line_items"))


@query(f"""WITH {SETTINGS}
SELECT u.user_id, l.id AS item_id, l.id || sep || r.id || sep || r.upload_id || sep || {_quote_sql("r.store_name")} || sep || {_quote_sql("l.item_type")} || sep || {_quote_sql("l.description")} || sep
  || CASE WHEN l.amount IS NULL THEN '""' ELSE {_amount_sql("l.amount")} END || sep || {_quote_sql("l.unit")} || sep || {_amount_sql("l.price_per_unit")} || sep || {_amount_sql("l.total_price")} || sep
  || CASE WHEN ic THEN {_quote_sql("r.currency")} || sep ELSE '' END || {_quote_sql(_date_sql("r.transaction_date"))} || sep || '""' AS line
FROM line_items l JOIN receipts r ON r.id = l.receipt_id JOIN receipt_uploads u ON u.id = r.upload_id JOIN settings USING (user_id)""")
def items_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.item_rows(*_t(spark, d, "receipts", "receipt_uploads", "users", "line_items"))


@query(f"""WITH {SETTINGS}, {EXPORT_STATS}
SELECT user_id, upload_id, upload_id || sep || {_quote_sql("file_name")} || sep || {_quote_sql("status")} || sep || total_detected || sep || successful || sep || failed || sep || processing || sep
  || {_quote_sql(_date_sql("created_at"))} || sep || {_quote_sql(_date_sql("updated_at"))} AS line FROM export_stats JOIN settings USING (user_id)""")
def uploads_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.upload_rows(*_t(spark, d, "receipt_uploads", "receipts", "users"))


@query("""SELECT receipt_id AS parent, id // 10000 AS chunk, count(*) AS n,
  '[' || string_agg('{"id":' || id || CASE WHEN item_type IS NULL THEN '' ELSE ',"itemType":"' || item_type || '"' END
    || CASE WHEN total_price IS NULL THEN '' ELSE ',"totalPrice":"' || total_price || '"' END || '}', ',' ORDER BY id) || ']' AS document
  FROM line_items WHERE receipt_id IS NOT NULL GROUP BY 1, 2""")
def nested_lines(spark: SparkSession, d: str) -> DataFrame:
    return exports.nested(table(spark, d, "line_items"), "receipt_id", {"itemType": "item_type", "totalPrice": "total_price"})


# --- duplicates ---------------------------------------------------------------------------------

OWNED = """
owned AS (
  SELECT r.id, r.store_name, r.total_amount, r.tax_amount, r.transaction_date, r.status, u.user_id, coalesce(i.n, 0) AS n_items
  FROM receipts r JOIN receipt_uploads u ON u.id = r.upload_id LEFT JOIN (SELECT receipt_id, count(*) AS n FROM line_items GROUP BY 1) i ON i.receipt_id = r.id),
pairs AS (
  SELECT a.*, b.id AS bid, b.store_name AS bstore, b.total_amount AS btotal, b.tax_amount AS btax, b.transaction_date AS bdate, b.n_items AS bitems
  FROM owned a JOIN owned b ON a.user_id = b.user_id AND a.id <> b.id AND b.status = 'processed'
   AND (a.transaction_date IS NULL OR b.transaction_date BETWEEN a.transaction_date - INTERVAL 3 DAYS AND a.transaction_date + INTERVAL 3 DAYS)),
measured AS (
  SELECT *, regexp_replace(lower(store_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(bstore), '[^a-z0-9]', '', 'g') AS y,
    round(abs(CAST(total_amount AS DOUBLE) - CAST(btotal AS DOUBLE)), 6) AS da, round(abs(CAST(tax_amount AS DOUBLE) - CAST(btax AS DOUBLE)), 6) AS dt,
    abs(floor((epoch_us(transaction_date) - epoch_us(bdate)) / 86400000000.0)) AS days, abs(epoch_us(transaction_date) - epoch_us(bdate)) / 60000000.0 AS mins, abs(n_items - bitems) AS di,
    (hour(transaction_date) <> 0 OR minute(transaction_date) <> 0) AS ta, (hour(bdate) <> 0 OR minute(bdate) <> 0) AS tb FROM pairs),
alike AS (
  SELECT *, CASE WHEN coalesce(length(store_name), 0) = 0 OR coalesce(length(bstore), 0) = 0 THEN 0.0 WHEN x = y THEN 100.0
     ELSE CAST(greatest(length(x), length(y)) - levenshtein(x, y) AS DOUBLE) / greatest(length(x), length(y), 1) * 100 END AS sim FROM measured),
points AS (
  SELECT id, bid AS candidate_id, user_id,
    CASE WHEN sim >= 100 THEN 30 WHEN sim >= 90 THEN 28 WHEN sim >= 80 THEN 23 WHEN sim >= 70 THEN 18 WHEN sim >= 60 THEN 12 ELSE 0 END AS store_points,
    CASE WHEN da <= 0 THEN 25 WHEN da <= 0.01 THEN 23 WHEN da <= 0.1 THEN 20 WHEN da <= 1 THEN 15 WHEN da <= 5 THEN 10 ELSE 0 END AS amount_points,
    CASE WHEN days = 0 AND ta AND tb AND mins <= 5 THEN 20 WHEN days = 0 AND ta AND tb AND mins <= 60 THEN 17 WHEN days = 0 THEN 12 WHEN days = 1 THEN 8 WHEN days <= 3 THEN 4 ELSE 0 END AS date_points,
    CASE WHEN di = 0 THEN 15 WHEN di = 1 THEN 12 WHEN di = 2 THEN 8 WHEN di = 3 THEN 5 ELSE 0 END AS item_points,
    CASE WHEN dt <= 0 THEN 10 WHEN dt <= 0.01 THEN 8 WHEN dt <= 0.1 THEN 5 ELSE 0 END AS tax_points,
    floor(round(sim, 6) + 0.5) >= 90 AND coalesce(floor(da * 100 + 0.5), 0) <= 1 AND coalesce(days, 0) = 0
      AND (NOT (coalesce(ta, true) AND coalesce(tb, true)) OR coalesce(days = 0 AND ta AND tb AND mins <= 5, false)) AND di = 0 AS outright FROM alike),
scored AS (SELECT *, store_points + amount_points + date_points + item_points + tax_points AS score FROM points),
best AS (
  SELECT id, candidate_id, CASE WHEN outright THEN 99 ELSE score END AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY outright DESC, CASE WHEN outright THEN 0 ELSE score END DESC, candidate_id) AS p FROM scored) WHERE p = 1),
classed AS (
  SELECT *, CASE WHEN score >= 95 THEN 'DEFINITE_DUPLICATE' WHEN score >= 85 THEN 'LIKELY_DUPLICATE' WHEN score >= 70 THEN 'POSSIBLE_DUPLICATE'
    WHEN score >= 50 THEN 'UNCERTAIN' ELSE 'NOT_DUPLICATE' END AS class FROM best WHERE score > 0)
"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    owned = receipt_duplicates.owned_receipts(*_t(spark, d, "receipts", "receipt_uploads", "line_items"))
    return receipt_duplicates.scored_pairs(receipt_duplicates.candidate_pairs(owned))


@query(f"WITH {OWNED} SELECT * FROM scored")
def dup_factors(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


@query(f"WITH {OWNED} SELECT * FROM classed")
def dup_best_match(spark: SparkSession, d: str) -> DataFrame:
    return receipt_duplicates.best_matches(_scored(spark, d))


@query(f"WITH {OWNED} SELECT class, count(*) AS n FROM classed GROUP BY 1")
def dup_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return dup_best_match(spark, d).groupBy("class").agg(F.count("*").alias("n"))


@query("""SELECT u.id AS upload_id, f.first_id FROM receipt_uploads u
  JOIN (SELECT user_id, image_hash, min(id) AS first_id FROM receipt_uploads WHERE image_hash IS NOT NULL GROUP BY 1, 2) f
  ON f.user_id = u.user_id AND f.image_hash = u.image_hash AND u.id > f.first_id""")
def exact_hash_dup(spark: SparkSession, d: str) -> DataFrame:
    return receipt_duplicates.equal_images(table(spark, d, "receipt_uploads"))


@query("""WITH p AS (SELECT min(id) AS id, user_id, h FROM (SELECT id, user_id, CAST(('0x' || trim(perceptual_hash)) AS UBIGINT) AS h FROM receipt_uploads
    WHERE perceptual_hash IS NOT NULL) GROUP BY user_id, h)
  SELECT b.id AS upload_id, a.id AS near_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS bits FROM p a JOIN p b ON a.user_id = b.user_id AND a.id < b.id AND bit_count(xor(a.h, b.h)) <= 8""")
def phash_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return receipt_duplicates.near_images(table(spark, d, "receipt_uploads"))


@query("""SELECT r.id AS receipt_id, s.id AS source_id, s.user_receipt_number AS source_number, CASE WHEN s.id IS NOT NULL THEN coalesce(u.upload_number, 0) END AS source_upload_number
  FROM receipts r LEFT JOIN receipts s ON s.id = r.duplicate_of_receipt_id AND s.deleted_at IS NULL LEFT JOIN receipt_uploads u ON u.id = s.upload_id WHERE r.is_duplicate""")
def dup_source_info(spark: SparkSession, d: str) -> DataFrame:
    return receipt_duplicates.sources_of_duplicates(*_t(spark, d, "receipts", "receipt_uploads"))


# --- text -----------------------------------------------------------------------------------------

OCR = """
tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(\\d)\\s*([.,])\\s*(\\d)', '\\1\\2\\3', 'g'), '\\d{1,3}(?:[.,]\\d{3})*[.,]\\d{1,4}|\\d+[.,]\\d{1,4}|\\d{1,7}')) AS tok FROM documents),
cut AS (SELECT doc_id, tok, regexp_extract(tok, '([.,])\\d*$', 1) AS mark, regexp_extract(tok, '[.,](\\d*)$', 1) AS tail, regexp_extract(tok, '^(.*)[.,]\\d*$', 1) AS head FROM tokens),
read AS (
  SELECT doc_id, unnest(CASE WHEN mark = '' THEN [tok]
    WHEN contains(tok, '.') AND contains(tok, ',') THEN [replace(head, CASE mark WHEN '.' THEN ',' ELSE '.' END, '') || '.' || tail]
    WHEN length(tail) < 3 THEN [head || '.' || tail] WHEN length(tail) = 3 THEN [head || '.' || tail, head || tail]
    ELSE [regexp_replace(tok, '[.,]', '', 'g')] END) AS v FROM cut),
nums AS (SELECT doc_id, TRY_CAST(regexp_extract(v, '^\\d+(?:\\.\\d+)?') AS DOUBLE) AS v FROM read)
"""


@query(f"""WITH {OCR} SELECT d.doc_id, count(n.v) AS n_numbers, CAST(coalesce(sum(CAST(n.v * 10000 AS HUGEINT)), 0) AS VARCHAR) AS checksum, max(n.v) AS largest
  FROM documents d LEFT JOIN nums n USING (doc_id) GROUP BY 1""")
def ocr_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", ocr.numbers_in(F.col("text")).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("decimal(38,0)"), lambda acc, v: (acc + F.round(v * 10000, 0).cast("decimal(30,0)")).cast("decimal(38,0)"))
    return n.select("doc_id", F.size("n").cast("long").alias("n_numbers"), total.cast("string").alias("checksum"), F.array_max("n").alias("largest"))


@query(f"""WITH {OCR}, marks AS (SELECT doc_id, count(*) FILTER (abs(v - 22) < 0.01) > 0 AS has_22, count(*) FILTER (abs(v - 19) < 0.01) > 0 AS has_19 FROM nums GROUP BY 1)
  SELECT d.doc_id, coalesce(has_22, false) AS has_22, coalesce(has_19, false) AS has_19 FROM documents d LEFT JOIN marks USING (doc_id)""")
def ocr_epsilon_match(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", ocr.numbers_in(F.col("text")).alias("n"))
    return n.select("doc_id", ocr.holds_number(F.col("n"), F.lit(22.0)).alias("has_22"), ocr.holds_number(F.col("n"), F.lit(19.0)).alias("has_19"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS raw FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS ls FROM documents WHERE text IS NOT NULL)),
  c AS (SELECT doc_id, pos, regexp_replace(raw, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS line FROM l),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(line, '[\s\x{00A0}]+', ' ', 'g')) ORDER BY pos) AS p FROM c WHERE line <> '')
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS merged, CAST(count(*) AS INTEGER) AS n_lines FROM k WHERE p = 1 GROUP BY 1""")
def ocr_line_merge(spark: SparkSession, d: str) -> DataFrame:
    return text_lines.merged_texts(table(spark, d, "documents"), "doc_id", "text")


@query(r"""SELECT doc_id, CASE WHEN p > 0 THEN regexp_replace(substring(text, greatest(1, p - 80), least(length(text), p + 84) - greatest(1, p - 80) + 1), '\s+', ' ', 'g') END AS around
  FROM (SELECT *, instr(lower(text), 'total') AS p FROM documents)""")
def ocr_context(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.text_around(F.col("text"), "total").alias("around"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""SELECT vec_id, CAST(sum(CASE WHEN x > 0 AND i < 64 THEN CAST(1 AS HUGEINT) << (i - 1) WHEN x > 0 THEN CAST(-1 AS HUGEINT) * (CAST(1 AS HUGEINT) << 63) ELSE 0 END) AS BIGINT) AS bits
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1""")
def sign_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", numbers.sign_bits(F.col("embedding")).alias("bits"))


# --- boxes ----------------------------------------------------------------------------------------

BOXES = """
boxes AS (
  SELECT l_orderkey AS image_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS box_no,
         CAST((l_partkey * 31 + l_linenumber * 170) % 700 AS DOUBLE) AS x, CAST((l_suppkey * 37 + l_linenumber * 90) % 700 AS DOUBLE) AS y,
         CAST(60 + l_quantity * 7 AS DOUBLE) AS width, CAST(50 + (l_partkey % 50) * 8 AS DOUBLE) AS height, CAST(l_linenumber AS DOUBLE) AS rotation, l_discount AS confidence FROM lineitem)
"""
OVERLAP = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"


def made_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes made of order lines; no table has any."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    at = lambda c, times, step: ((F.col(c) * times + F.col("l_linenumber") * step) % 700).cast("double")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.row_number().over(order).alias("box_no"), at("l_partkey", 31, 170).alias("x"), at("l_suppkey", 37, 90).alias("y"),
        (60 + F.col("l_quantity") * 7).cast("double").alias("width"), (50 + F.col("l_partkey") % 50 * 8).cast("double").alias("height"),
        F.col("l_linenumber").cast("double").alias("rotation"), F.col("l_discount").alias("confidence"),
    )


@query(f"""WITH {BOXES}, p AS (SELECT a.image_id, a.box_no AS box_a, b.box_no AS box_b, {OVERLAP} AS o, a.width * a.height AS aa, b.width * b.height AS bb
    FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_no < b.box_no)
  SELECT image_id, box_a, box_b, round(o / (aa + bb - o), 9) AS iou, round(o / aa, 9) AS cover_ab, round(o / bb, 9) AS cover_ba FROM p WHERE o > 0""")
def box_pairs_iou(spark: SparkSession, d: str) -> DataFrame:
    p = boxes.box_pairs(made_boxes(spark, d))
    return p.select("image_id", "box_a", "box_b", *(F.round(c, 9).alias(c) for c in ("iou", "cover_ab", "cover_ba")))


@query(f"""WITH {BOXES}, s1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM boxes) WHERE n = 1 OR width * height >= 10000),
  holders AS (SELECT a.image_id, a.box_no FROM s1 a JOIN s1 b ON a.image_id = b.image_id AND a.box_no <> b.box_no AND {OVERLAP} / (b.width * b.height) >= 0.6 GROUP BY 1, 2 HAVING count(*) >= 2),
  s2 AS (SELECT * FROM s1 ANTI JOIN holders USING (image_id, box_no))
  SELECT image_id, box_no FROM s2 a WHERE NOT EXISTS (SELECT 1 FROM s2 b WHERE a.image_id = b.image_id AND a.box_no <> b.box_no AND {OVERLAP} / (a.width * a.height) >= 0.8
    AND a.width * a.height < b.width * b.height * 0.7)""")
def box_filter(spark: SparkSession, d: str) -> DataFrame:
    return boxes.plausible_boxes(made_boxes(spark, d)).select("image_id", "box_no")


@query(f"""WITH {BOXES}, c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (width >= height) OVER w AS wide FROM boxes WINDOW w AS (PARTITION BY image_id))
  SELECT image_id, box_no, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x, box_no) AS INTEGER) AS place FROM c
  WHERE n < 3 OR CASE WHEN wide >= 2 * (n - wide) THEN width >= height WHEN n - wide >= 2 * wide THEN width < height ELSE true END""")
def box_orientation(spark: SparkSession, d: str) -> DataFrame:
    return boxes.majority_orientation(made_boxes(spark, d)).select("image_id", "box_no", "place")


@query(f"""WITH {BOXES}, e AS (SELECT image_id, box_no, greatest(0, floor((x - width * 0.05) / 1000 * 1600)) AS l, greatest(0, floor((y - height * 0.05) / 1000 * 1200)) AS t,
    least(1600, ceil((x + width * 1.05) / 1000 * 1600)) AS r, least(1200, ceil((y + height * 1.05) / 1000 * 1200)) AS b FROM boxes)
  SELECT image_id, box_no, CAST(l AS DOUBLE) AS left, CAST(t AS DOUBLE) AS top, CAST(r - l AS DOUBLE) AS crop_width, CAST(b - t AS DOUBLE) AS crop_height FROM e WHERE r > l AND b > t""")
def box_pixels(spark: SparkSession, d: str) -> DataFrame:
    return boxes.pixel_crops(made_boxes(spark, d), 1600, 1200)


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_no) AS p, count(*) OVER (PARTITION BY image_id) AS n,
    {{'box_no': box_no, 'x': x, 'y': y, 'width': width, 'height': height, 'confidence': confidence}} AS b FROM boxes),
  f(image_id, p, n, kept) AS (SELECT image_id, p, n, [b] FROM o WHERE p = 1
    UNION ALL SELECT f.image_id, f.p + 1, f.n, CASE WHEN len(list_filter(f.kept, lambda k: NOT (
        greatest(0, least(o.b.x + o.b.width, k.x + k.width) - greatest(o.b.x, k.x)) * greatest(0, least(o.b.y + o.b.height, k.y + k.height) - greatest(o.b.y, k.y))
        <= 0.5 * (o.b.width * o.b.height + k.width * k.height
        - greatest(0, least(o.b.x + o.b.width, k.x + k.width) - greatest(o.b.x, k.x)) * greatest(0, least(o.b.y + o.b.height, k.y + k.height) - greatest(o.b.y, k.y)))))) = 0
      THEN list_append(f.kept, o.b) ELSE f.kept END FROM f JOIN o ON o.image_id = f.image_id AND o.p = f.p + 1),
  k AS (SELECT image_id, unnest(kept) AS b FROM f WHERE p = n)
  SELECT image_id, b.box_no AS box_no, b.x AS x, b.y AS y, b.width AS width, b.height AS height, b.confidence AS confidence FROM k""")
def box_nms(spark: SparkSession, d: str) -> DataFrame:
    return boxes.suppressed(made_boxes(spark, d))


@query()
def box_merge(spark: SparkSession, d: str) -> DataFrame:
    return boxes.merged(made_boxes(spark, d))


# --- edits ----------------------------------------------------------------------------------------

FIRST = """
first_values AS (SELECT entity_type, entity_id, field_name, old_value AS original FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, field_name ORDER BY changed_at, id) AS p FROM receipt_edit_history) WHERE p = 1)
"""


@query(f"WITH {FIRST} SELECT * FROM first_values")
def edit_originals(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "receipt_edit_history")
    kinds = [edits.originals(h, k).withColumn("entity_type", F.lit(k)) for k in ("receipt", "line_item")]
    return kinds[0].unionAll(kinds[1])


@query(f"""WITH {FIRST}, o AS (SELECT entity_id, bool_or(field_name = 'storeName') AS hs, max(original) FILTER (field_name = 'storeName') AS s, bool_or(field_name = 'totalAmount') AS ht,
    max(original) FILTER (field_name = 'totalAmount') AS t, bool_or(field_name = 'taxAmount') AS hx, max(original) FILTER (field_name = 'taxAmount') AS x, bool_or(field_name = 'currency') AS hc,
    max(original) FILTER (field_name = 'currency') AS c, bool_or(field_name = 'transactionDate') AS hd, max(original) FILTER (field_name = 'transactionDate') AS d
  FROM first_values WHERE entity_type = 'receipt' AND field_name IN ('storeName', 'totalAmount', 'taxAmount', 'currency', 'transactionDate') GROUP BY 1)
  SELECT r.id, CASE WHEN hs THEN s ELSE store_name END AS store_name, CASE WHEN ht THEN TRY_CAST(trim(t) AS DECIMAL(13, 4)) ELSE total_amount END AS total_amount,
    CASE WHEN hx THEN TRY_CAST(trim(x) AS DECIMAL(13, 4)) ELSE tax_amount END AS tax_amount, CASE WHEN hc THEN c ELSE currency END AS currency,
    CASE WHEN hd THEN TRY_CAST(trim(replace(replace(d, 'T', ' '), 'Z', '')) AS TIMESTAMP) ELSE transaction_date END AS transaction_date, o.entity_id IS NOT NULL AS was_edited
  FROM receipts r LEFT JOIN o ON o.entity_id = r.id""")
def edit_overlay(spark: SparkSession, d: str) -> DataFrame:
    return edits.restored_receipts(*_t(spark, d, "receipts", "receipt_edit_history"))


@query("SELECT entity_type, field_name, count(*) AS n FROM receipt_edit_history WHERE old_value IS DISTINCT FROM new_value GROUP BY 1, 2")
def edit_changes(spark: SparkSession, d: str) -> DataFrame:
    return edits.real_changes(table(spark, d, "receipt_edit_history")).groupBy("entity_type", "field_name").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY changed_at DESC, id DESC) AS p FROM receipt_edit_history WHERE entity_type = 'line_item') WHERE p = 1)
  SELECT l.id, CASE WHEN d.id IS NOT NULL THEN d.new_value ELSE l.description END AS description, CASE WHEN u.id IS NOT NULL THEN u.new_value ELSE l.unit END AS unit,
    CASE WHEN a.id IS NOT NULL THEN TRY_CAST(trim(a.new_value) AS DECIMAL(10, 3)) ELSE l.amount END AS amount
  FROM line_items l LEFT JOIN n d ON d.entity_id = l.id AND d.field_name = 'description' LEFT JOIN n u ON u.entity_id = l.id AND u.field_name = 'unit'
  LEFT JOIN n a ON a.entity_id = l.id AND a.field_name = 'amount'""")
def edit_applied(spark: SparkSession, d: str) -> DataFrame:
    li, h = _t(spark, d, "line_items", "receipt_edit_history")
    columns = {"description": "description", "unit": "unit", "amount": "amount"}
    return state_changes.with_edits(li.select("id", *columns), h.where("entity_type = 'line_item'"), "id", columns)


@query(f"""WITH {OWNED} SELECT r.id, coalesce(c.id IS NOT NULL, false) OR coalesce(r.is_duplicate, false) AS is_duplicate, coalesce(c.candidate_id, r.duplicate_of_receipt_id) AS duplicate_of_receipt_id,
  coalesce(CAST(c.score AS DECIMAL(5, 2)), r.duplicate_confidence_score) AS duplicate_confidence_score FROM receipts r LEFT JOIN (SELECT * FROM classed WHERE score >= 85) c ON c.id = r.id""")
def after_marking_duplicates(spark: SparkSession, d: str) -> DataFrame:
    marked = state_changes.marked_duplicates(table(spark, d, "receipts"), dup_best_match(spark, d).where("score >= 85"))
    return marked.select("id", F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"), "duplicate_of_receipt_id", "duplicate_confidence_score")


# --- state changes ----------------------------------------------------------------------------------

GONE = "gone AS (SELECT id FROM receipt_uploads WHERE status = 'failed'), rgone AS (SELECT id FROM receipts WHERE upload_id IN (SELECT id FROM gone))"


@query(f"""WITH {GONE} SELECT 'receipt_uploads' AS name, id FROM receipt_uploads WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'receipts', id FROM receipts WHERE id NOT IN (SELECT id FROM rgone)
  UNION ALL SELECT 'line_items', id FROM line_items WHERE receipt_id IS NULL OR receipt_id NOT IN (SELECT id FROM rgone)
  UNION ALL SELECT 'processing_errors', id FROM processing_errors WHERE upload_id IS NULL OR upload_id NOT IN (SELECT id FROM gone)""")
def after_delete_uploads(spark: SparkSession, d: str) -> DataFrame:
    names = ["receipt_uploads", "receipts", "line_items", "processing_errors"]
    tables = dict(zip(names, _t(spark, d, *names)))
    left = state_changes.without_uploads(tables, tables["receipt_uploads"].where("status = 'failed'"))
    parts = [df.select(F.lit(n).alias("name"), "id") for n, df in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("""SELECT id, CASE WHEN is_duplicate AND deleted_at IS NULL THEN TIMESTAMP '2026-01-01 00:00:00' ELSE deleted_at END AS deleted_at FROM receipts""")
def after_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipts")
    return state_changes.soft_deleted(r, r.where("is_duplicate"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).select("id", "deleted_at")


@query("""SELECT id, CASE WHEN NOT coalesce(edited_at IS NOT NULL, false) THEN deleted_at END AS deleted_at FROM receipts""")
def after_restore(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipts")
    return state_changes.undeleted(r, r.where("edited_at IS NOT NULL")).select("id", "deleted_at")


@query("""SELECT id FROM receipts WHERE id IN (SELECT id FROM receipts WHERE duplicate_of_receipt_id IS NOT NULL UNION ALL SELECT duplicate_of_receipt_id FROM receipts WHERE duplicate_of_receipt_id IS NOT NULL)""")
def either_end_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipts")
    links = r.where("duplicate_of_receipt_id IS NOT NULL").select(F.col("id").alias("left_id"), "duplicate_of_receipt_id")
    return state_changes.either_end(r, "id", links, "left_id", "duplicate_of_receipt_id").select("id")


@query("""WITH i AS (SELECT receipt_id, count(*) AS n FROM line_items GROUP BY 1), r AS (SELECT upload_id, count(*) AS n, sum(coalesce(i.n, 0)) AS items FROM receipts LEFT JOIN i ON i.receipt_id = id GROUP BY 1),
  e AS (SELECT upload_id, count(*) AS n FROM processing_errors GROUP BY 1)
  SELECT u.user_id, count(*) AS uploads, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS receipts, CAST(coalesce(sum(r.items), 0) AS BIGINT) AS line_items, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS errors
  FROM receipt_uploads u LEFT JOIN r ON r.upload_id = u.id LEFT JOIN e ON e.upload_id = u.id GROUP BY 1""")
def user_data_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ["receipt_uploads", "receipts", "line_items", "processing_errors"]
    return state_changes.user_data_counts(dict(zip(names, _t(spark, d, *names))))


@query("SELECT count(*) FILTER (original_image_url IS NOT NULL) AS with_original, count(*) FILTER (original_image_url IS NOT NULL AND status IN ('completed', 'partly_completed')) AS can_be_cleaned, user_id FROM receipt_uploads GROUP BY user_id")
def storage_stats(spark: SparkSession, d: str) -> DataFrame:
    has = F.col("original_image_url").isNotNull()
    return table(spark, d, "receipt_uploads").groupBy("user_id").agg(
        F.count_if(has).alias("with_original"), F.count_if(has & F.col("status").isin("completed", "partly_completed")).alias("can_be_cleaned")
    )


@query(f"WITH {SETTINGS} SELECT user_id, ds AS decimal_separator, af AS amount_format, df AS date_format, ic AS include_currency, ih AS include_header, sep AS delimiter FROM settings")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    return exports.settings_of(table(spark, d, "users"))


# --- jobs and errors ----------------------------------------------------------------------------------

@query("""SELECT category, json_extract_string(metadata, '$.type') AS type, count(*) AS n, count(DISTINCT (upload_id, receipt_id, category, message, metadata, created_at)) AS n_distinct,
  min(json_extract_string(metadata, '$.details.diff')) AS least_diff FROM processing_errors GROUP BY 1, 2""")
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "processing_errors")
    whole = F.struct("upload_id", "receipt_id", "category", "message", "metadata", "created_at")
    return e.groupBy("category", F.get_json_object("metadata", "$.type").alias("type")).agg(
        F.count("*").alias("n"), F.count_distinct(whole).alias("n_distinct"), F.min(F.get_json_object("metadata", "$.details.diff")).alias("least_diff")
    )


@query("""SELECT upload_id, max(CAST(json_extract_string(metadata, '$.resetTime') AS TIMESTAMP)) AS reset_at, count(*) AS n FROM processing_errors
  WHERE json_extract_string(metadata, '$.errorType') = 'RATE_LIMITED' AND TRY_CAST(json_extract_string(metadata, '$.resetTime') AS TIMESTAMP) IS NOT NULL GROUP BY 1""")
def reset_times(spark: SparkSession, d: str) -> DataFrame:
    return jobs.reset_times(table(spark, d, "processing_errors"))


@query("""SELECT e.upload_id, u.user_id, count(*) AS n_errors FROM processing_errors e JOIN receipt_uploads u ON u.id = e.upload_id JOIN users s ON s.id = u.user_id
  WHERE s.auto_resume_rate_limited AND e.category = 'SYSTEM_ERROR' GROUP BY 1, 2""")
def resume_candidates(spark: SparkSession, d: str) -> DataFrame:
    e, u, s = _t(spark, d, "processing_errors", "receipt_uploads", "users")
    failed = e.where("category = 'SYSTEM_ERROR'").groupBy("upload_id").agg(F.count("*").alias("n_errors"))
    wanted = u.join(s.where("auto_resume_rate_limited").select(F.col("id").alias("owner")), F.col("user_id") == F.col("owner"), "left_semi")
    return failed.join(wanted.select(F.col("id").alias("upload_id"), "user_id"), "upload_id")


@query("""SELECT id, upload_id, coalesce(max(CASE WHEN status = 'rate_limited' THEN 1 ELSE 0 END) OVER (PARTITION BY upload_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped
  FROM receipts""")
def rate_limit_shortcircuit(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipts").withColumn("hit", F.coalesce(F.col("status") == "rate_limited", F.lit(False)))
    return jobs.after_limit(r, "upload_id", "id", "hit").select("id", "upload_id", "skipped")


@query("""SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, greatest(0, count(*) - 60) AS over FROM events GROUP BY 1, 2""")
def requests_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return jobs.per_minute(table(spark, d, "events"), "user_id", "ts", 60)


@query("""SELECT event_id, job_id FROM (SELECT event_id, event_id % 5000 AS job_id, row_number() OVER (PARTITION BY event_id % 5000 ORDER BY ts, event_id) AS p FROM events) WHERE p = 1""")
def job_idempotency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("job_id", F.col("event_id") % 5000)
    return jobs.first_of_each(e, "job_id", "ts").select("event_id", "job_id")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
