"""Queries of the life of uploads, receipts and lines, and of single functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import numbers, ocr, structures, text
from tallyforge.operators import boxes, edits, lifecycle, state_changes, text_lines, upload_stats
from tallyforge.plans.receipts import BOXES, EXPORT_STATS, FIRST, OCR, STATS, made_boxes
from tallyforge.storage import table
from tallyforge.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2026-01-01 00:00:00"


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


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in ("receipt_uploads", "receipts", "line_items", "processing_errors")}


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _states(tables: dict[str, DataFrame], states: dict[str, list[str]]) -> DataFrame:
    """(name, id, state) of each table: the given columns as one text."""
    parts = [
        tables[n].select(F.lit(n).alias("name"), "id", F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns), F.lit("")).alias("state"))
        for n, columns in states.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _state_sql(*columns: str) -> str:
    return " || '|' || ".join([*(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns), "''"])


# --- pages and details of uploads --------------------------------------------------------------


@query(f"""WITH {STATS}, mine AS (SELECT * FROM stats WHERE status = 'completed')
  SELECT * EXCLUDE (place), place, total > 15 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at, upload_id) AS place,
    count(*) OVER (PARTITION BY user_id) AS total FROM mine) WHERE place > 5 AND place <= 15""")
def uploads_second_page(spark: SparkSession, d: str) -> DataFrame:
    """Completed uploads, the longest unchanged first: rows 6 to 15 of each user."""
    stats = upload_stats.upload_statistics(*_t(spark, d, "receipt_uploads", "receipts"))
    return upload_stats.page(stats, limit=10, offset=5, sort_by="updatedAt", descending=False, status="completed")


@query(f"""WITH {STATS} SELECT * EXCLUDE (place), place, total > 100 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, upload_id) AS place,
    count(*) OVER (PARTITION BY user_id) AS total FROM stats) WHERE place <= 100""")
def uploads_page_held_in_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Parameters out of bounds: the largest page, from the start, in the usual order, of every state."""
    stats = upload_stats.upload_statistics(*_t(spark, d, "receipt_uploads", "receipts"))
    return upload_stats.page(stats, limit=5000, offset=-3, sort_by="password", status="unheard")


def _ids(condition: str) -> str:
    return f"coalesce(string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY r.id) FILTER ({condition}), '')"


@query(f"""WITH r AS (SELECT upload_id, count(*) FILTER (deleted_at IS NULL) AS n_detected, count(*) FILTER (deleted_at IS NULL AND status = 'processed') AS n_processed,
    count(*) FILTER (deleted_at IS NULL AND status IN ('failed', 'unreadable')) AS n_failed, count(*) FILTER (deleted_at IS NOT NULL) AS n_deleted, count(*) FILTER (status = 'rate_limited') AS n_rate_limited,
    {_ids("status = 'processed' AND review_status IN ('not_required', 'reviewed')")} AS successful_ids, {_ids("review_status = 'needs_review'")} AS needs_review_ids,
    {_ids("status IN ('failed', 'unreadable')")} AS failed_ids, {_ids("status = 'pending'")} AS processing_ids, {_ids("status = 'rate_limited'")} AS rate_limited_ids, {_ids("true")} AS all_ids
  FROM receipts r WHERE upload_id IS NOT NULL GROUP BY 1),
  e AS (SELECT upload_id, max(TRY_CAST(json_extract_string(metadata, '$.resetTime') AS TIMESTAMP)) AS resumable_at,
    arg_min(json_extract_string(metadata, '$.provider'), id) FILTER (nullif(json_extract_string(metadata, '$.provider'), '') IS NOT NULL) AS provider
  FROM processing_errors WHERE json_extract_string(metadata, '$.errorType') = 'RATE_LIMITED' GROUP BY 1)
  SELECT u.id AS upload_id, user_id, status AS upload_status, coalesce(n_detected, 0) AS n_detected, coalesce(n_processed, 0) AS n_processed, coalesce(n_failed, 0) AS n_failed, coalesce(n_deleted, 0) AS n_deleted,
    coalesce(n_rate_limited, 0) AS n_rate_limited, coalesce(successful_ids, '') AS successful_ids, coalesce(needs_review_ids, '') AS needs_review_ids, coalesce(failed_ids, '') AS failed_ids,
    coalesce(processing_ids, '') AS processing_ids, coalesce(rate_limited_ids, '') AS rate_limited_ids, coalesce(all_ids, '') AS all_ids,
    CASE WHEN n_rate_limited > 0 THEN resumable_at END AS resumable_at, CASE WHEN n_rate_limited > 0 THEN provider END AS provider
  FROM receipt_uploads u LEFT JOIN r ON r.upload_id = u.id LEFT JOIN e ON e.upload_id = u.id""")
def upload_details(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.upload_details(*_t(spark, d, "receipt_uploads", "receipts", "processing_errors")).withColumn("resumable_at", F.col("resumable_at").cast("timestamp_ntz"))


@query("""SELECT upload_id, CASE WHEN count(*) = count(*) FILTER (status = 'processed') THEN 'completed' WHEN count(*) = count(*) FILTER (status IN ('failed', 'unreadable')) THEN 'failed' ELSE 'partly_completed' END AS all_rows,
  CASE WHEN count(*) FILTER (deleted_at IS NULL) = count(*) FILTER (deleted_at IS NULL AND status = 'processed') THEN 'completed'
    WHEN count(*) FILTER (deleted_at IS NULL) = count(*) FILTER (deleted_at IS NULL AND status IN ('failed', 'unreadable')) THEN 'failed' ELSE 'partly_completed' END AS live_rows
  FROM receipts WHERE upload_id IS NOT NULL GROUP BY 1""")
def upload_rollups(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.rolled_up(table(spark, d, "receipts"))


@query(f"""WITH {EXPORT_STATS} SELECT upload_id, user_id, total_detected, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, upload_id) AS INTEGER) AS place FROM export_stats""")
def uploads_export_order(spark: SparkSession, d: str) -> DataFrame:
    """The export's uploads, newest first in each user's file."""
    from pyspark.sql import Window

    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "upload_id")
    stats = upload_stats.export_statistics(*_t(spark, d, "receipt_uploads", "receipts"))
    return stats.select("upload_id", "user_id", "total_detected", F.row_number().over(newest).alias("place"))


@query("""SELECT id, upload_id, CAST(15 + round(row_number() OVER (PARTITION BY upload_id ORDER BY id) * 80.0 / count(*) OVER (PARTITION BY upload_id), 0) AS INTEGER) AS progress
  FROM receipts WHERE upload_id IS NOT NULL""")
def processing_progress(spark: SparkSession, d: str) -> DataFrame:
    """Per cent done after each receipt of an upload."""
    r = table(spark, d, "receipts").where("upload_id IS NOT NULL").select("id", "upload_id")
    n = r.groupBy(F.col("upload_id").alias("of_upload")).agg(F.count("*").alias("n"))
    placed = upload_stats.numbered(r, "upload_id", "id").join(n, F.col("upload_id") == F.col("of_upload"))
    return placed.select("id", "upload_id", (15 + F.round(F.col("number") * 80.0 / F.col("n"), 0)).cast("int").alias("progress"))


@query("""SELECT r.* FROM (SELECT id, upload_id, store_name, total_amount FROM receipts) r WHERE id IN (SELECT duplicate_of_receipt_id FROM receipts)""")
def receipts_looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Receipts looked up by key: those that others are said to repeat."""
    r = table(spark, d, "receipts")
    return lifecycle.marked(r, "id", r.select("duplicate_of_receipt_id")).where("is_named").select("id", "upload_id", "store_name", "total_amount")


# --- reprocess, resume, clean up ----------------------------------------------------------------

REDO = "redo AS (SELECT id, upload_id FROM receipts WHERE status IN ('failed', 'unreadable'))"


@query(f"""WITH {REDO}
  SELECT 'receipts' AS name, id, {_state_sql("CASE WHEN id IN (SELECT id FROM redo) THEN 'pending' ELSE status END", "CASE WHEN id IN (SELECT id FROM redo) THEN NULL ELSE store_name END", "CASE WHEN id IN (SELECT id FROM redo) THEN NULL ELSE total_amount END")} AS state FROM receipts
  UNION ALL SELECT 'line_items', id, '' FROM line_items WHERE receipt_id IS NULL OR receipt_id NOT IN (SELECT id FROM redo)
  UNION ALL SELECT 'processing_errors', id, '' FROM processing_errors WHERE receipt_id IS NULL OR receipt_id NOT IN (SELECT id FROM redo)
  UNION ALL SELECT 'receipt_uploads', id, {_state_sql("CASE WHEN id IN (SELECT upload_id FROM redo) THEN 'processing' ELSE status END")} FROM receipt_uploads""")
def after_reprocess_receipts(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    after = lifecycle.reprocessed_receipts(t, t["receipts"].where("status IN ('failed', 'unreadable')").select("id"))
    return _states(after, {"receipts": ["status", "store_name", "total_amount"], "line_items": [], "processing_errors": [], "receipt_uploads": ["status"]})


@query(f"""WITH redo AS (SELECT id FROM receipt_uploads WHERE batch_no = 1 AND status IS DISTINCT FROM 'duplicate'), gone AS (SELECT id FROM receipts WHERE upload_id IN (SELECT id FROM redo))
  SELECT 'receipt_uploads' AS name, id, {_state_sql("CASE WHEN id IN (SELECT id FROM redo) THEN 'processing' ELSE status END", "CASE WHEN id IN (SELECT id FROM redo) THEN NULL ELSE has_receipts END")} AS state FROM receipt_uploads
  UNION ALL SELECT 'receipts', id, '' FROM receipts WHERE upload_id IS NULL OR upload_id NOT IN (SELECT id FROM redo)
  UNION ALL SELECT 'line_items', id, '' FROM line_items WHERE receipt_id IS NULL OR receipt_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'processing_errors', id, '' FROM processing_errors WHERE upload_id IS NULL OR upload_id NOT IN (SELECT id FROM redo)""")
def after_reprocess_uploads(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    after = lifecycle.reprocessed_uploads(t, t["receipt_uploads"].where("batch_no = 1").select("id"))
    return _states(after, {"receipt_uploads": ["status", "has_receipts"], "receipts": [], "line_items": [], "processing_errors": []})


LIMITED = "json_extract_string(metadata, '$.errorType') = 'RATE_LIMITED'"
BACK = f"back AS (SELECT id, upload_id FROM receipts WHERE status = 'rate_limited' AND id IN (SELECT receipt_id FROM processing_errors WHERE {LIMITED}))"


@query(f"""WITH {BACK}
  SELECT 'receipts' AS name, id, {_state_sql("CASE WHEN id IN (SELECT id FROM back) THEN 'pending' ELSE status END")} AS state FROM receipts
  UNION ALL SELECT 'processing_errors', id, '' FROM processing_errors WHERE NOT (coalesce({LIMITED}, false) AND receipt_id IS NOT NULL AND coalesce(upload_id IN (SELECT upload_id FROM back), false))
  UNION ALL SELECT 'receipt_uploads', id, {_state_sql("CASE WHEN id IN (SELECT upload_id FROM back) THEN 'processing' ELSE status END")} FROM receipt_uploads
  UNION ALL SELECT 'queue', id, {_state_sql("row_number() OVER (PARTITION BY upload_id ORDER BY id) - 1")} FROM back""")
def after_resume(spark: SparkSession, d: str) -> DataFrame:
    after = lifecycle.resumed(_tables(spark, d))
    return _states(after, {"receipts": ["status"], "processing_errors": [], "receipt_uploads": ["status"], "queue": ["delay_no"]})


@query(f"WITH {BACK} SELECT upload_id, count(*) AS n FROM back GROUP BY 1")
def resumable_counts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.resumable(*_t(spark, d, "receipts", "processing_errors")).groupBy("upload_id").agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN status IN ('completed', 'partly_completed') THEN NULL ELSE original_image_url END AS original_image_url FROM receipt_uploads""")
def after_storage_cleanup(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "receipt_uploads")
    done = u.where("original_image_url IS NOT NULL AND status IN ('completed', 'partly_completed')").select("id")
    return lifecycle.updated(u, "id", done, {"original_image_url": F.lit(None)}).select("id", "original_image_url")


@query("""SELECT id, original_image_url AS old_value, '/files/' || left(image_hash, 12) || '.webp' AS new_value, 'processing' AS status FROM receipt_uploads WHERE status = 'failed' AND image_hash IS NOT NULL""")
def after_replace_image(spark: SparkSession, d: str) -> DataFrame:
    """Failed uploads with a new picture named by its content, and the change that says so."""
    u = table(spark, d, "receipt_uploads")
    new = u.where("status = 'failed' AND image_hash IS NOT NULL").select("id", F.concat(F.lit("/files/"), F.substring("image_hash", 1, 12), F.lit(".webp")).alias("url"))
    after = lifecycle.updated(u, "id", new, {"status": F.lit("processing")}).select("id", "status", F.col("original_image_url").alias("old_value"))
    return after.join(new.withColumnRenamed("id", "new_id"), F.col("id") == F.col("new_id")).select("id", "old_value", F.col("url").alias("new_value"), "status")


@query("""SELECT id, CASE WHEN review_status = 'not_required' AND status = 'processed' AND id IN (SELECT receipt_id FROM processing_errors WHERE category = 'VALIDATION_WARNING')
  THEN 'needs_review' ELSE review_status END AS review_status FROM receipts""")
def after_backfill_review(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.backfilled_review(*_t(spark, d, "receipts", "processing_errors")).select("id", "review_status")


@query("""WITH gone AS (SELECT id FROM users WHERE auto_resume_rate_limited), ugone AS (SELECT id FROM receipt_uploads WHERE user_id IN (SELECT id FROM gone)), rgone AS (SELECT id FROM receipts WHERE upload_id IN (SELECT id FROM ugone))
  SELECT 'receipt_uploads' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM receipt_uploads WHERE id NOT IN (SELECT id FROM ugone)
  UNION ALL SELECT 'receipts', count(*), CAST(sum(id) AS BIGINT) FROM receipts WHERE upload_id IS NULL OR upload_id NOT IN (SELECT id FROM ugone)
  UNION ALL SELECT 'line_items', count(*), CAST(sum(id) AS BIGINT) FROM line_items WHERE receipt_id IS NULL OR receipt_id NOT IN (SELECT id FROM rgone)
  UNION ALL SELECT 'processing_errors', count(*), CAST(sum(id) AS BIGINT) FROM processing_errors WHERE upload_id IS NULL OR upload_id NOT IN (SELECT id FROM ugone)""")
def after_delete_users(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table when the data of some users are gone."""
    t = _tables(spark, d)
    users = table(spark, d, "users").where("auto_resume_rate_limited").select("id")
    uploads = lifecycle.marked(t["receipt_uploads"], "user_id", users).where("is_named").select("id")
    left = state_changes.without_uploads(t, uploads)
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum("id").alias("ids")) for n, df in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# --- edits --------------------------------------------------------------------------------------


@query("""WITH new AS (SELECT id AS receipt_id, store_name AS description, total_amount AS total_price FROM receipts WHERE total_amount IS NOT NULL AND store_name IS NOT NULL AND status = 'processed')
  SELECT id, receipt_id, description, total_price, item_type, amount, is_user_added FROM line_items
  UNION ALL SELECT (SELECT max(id) FROM line_items) + row_number() OVER (ORDER BY receipt_id), receipt_id, description, total_price, 'product', 1.000, true FROM new""")
def after_add_items(spark: SparkSession, d: str) -> DataFrame:
    """A line of its own for each processed receipt, named like the shop."""
    li, r = _t(spark, d, "line_items", "receipts")
    new = r.where("total_amount IS NOT NULL AND store_name IS NOT NULL AND status = 'processed'").select(F.col("id").alias("receipt_id"), F.col("store_name").alias("description"), F.col("total_amount").alias("total_price"))
    return lifecycle.with_new_items(li, new).select("id", "receipt_id", "description", "total_price", "item_type", "amount", "is_user_added")


@query(f"""WITH gone AS (SELECT id FROM line_items WHERE extraction_flag = 'low_confidence' AND deleted_at IS NULL), h AS (SELECT max(id) AS m FROM receipt_edit_history)
  SELECT 'line_items' AS name, id, {_state_sql(f"CASE WHEN id IN (SELECT id FROM gone) THEN TIMESTAMP '{NOW}' ELSE deleted_at END")} AS state FROM line_items
  UNION ALL SELECT 'receipt_edit_history', h.m + row_number() OVER (ORDER BY g.id), {_state_sql("'line_item'", "g.id", "'__deleted__'", "'false'", "'true'", "NULL")} FROM gone g, h
  UNION ALL SELECT 'receipt_edit_history', id, {_state_sql("entity_type", "entity_id", "field_name", "old_value", "new_value", "changed_by")} FROM receipt_edit_history""")
def after_delete_items(spark: SparkSession, d: str) -> DataFrame:
    """Lines of low confidence marked as deleted, and the edit history with these changes appended."""
    li, h = _t(spark, d, "line_items", "receipt_edit_history")
    after, changes = lifecycle.without_items(li, li.where("extraction_flag = 'low_confidence'").select("id"), _now())
    rows = lifecycle.history_rows(changes, "line_item", F.lit(None).cast("long"), _now())
    longer = lifecycle.appended(h, rows, order=["entity_id"])
    return _states({"line_items": after, "receipt_edit_history": longer}, {"line_items": ["deleted_at"], "receipt_edit_history": ["entity_type", "entity_id", "field_name", "old_value", "new_value", "changed_by"]})


def _reset_sql(column: str, field: str, kind: str, kept: bool) -> str:
    value = f"f.{field}" if kind == "VARCHAR" else f"TRY_CAST(trim(f.{field}) AS {kind})"
    return f"CASE WHEN own AND f.has_{field}{f' AND f.{field} IS NOT NULL' if kept else ''} THEN {value} ELSE l.{column} END AS {column}"


_RESETS = [("description", "description", "VARCHAR", True), ("amount", "amount", "DECIMAL(10, 3)", False), ("unit", "unit", "VARCHAR", False), ("price_per_unit", "pricePerUnit", "DECIMAL(13, 4)", False), ("total_price", "totalPrice", "DECIMAL(13, 4)", True)]


@query(f"""WITH {FIRST}, f AS (SELECT entity_id, {", ".join(f"bool_or(field_name = '{x}') AS has_{x}, max(original) FILTER (field_name = '{x}') AS {x}" for _, x, _, _ in _RESETS)}
    FROM first_values WHERE entity_type = 'line_item' GROUP BY 1),
  l AS (SELECT *, receipt_id IN (SELECT id FROM receipts WHERE edited_at IS NOT NULL) AND NOT is_user_added AS own, receipt_id IN (SELECT id FROM receipts WHERE edited_at IS NOT NULL) AND is_user_added AS added FROM line_items)
  SELECT id, {", ".join(_reset_sql(*x) for x in _RESETS)}, CASE WHEN added THEN TIMESTAMP '{NOW}' WHEN own THEN NULL ELSE deleted_at END AS deleted_at FROM l LEFT JOIN f ON f.entity_id = l.id""")
def after_reset_items(spark: SparkSession, d: str) -> DataFrame:
    """Lines of edited receipts as first extracted."""
    li, h, r = _t(spark, d, "line_items", "receipt_edit_history", "receipts")
    after = lifecycle.reset_items(li, h, r.where("edited_at IS NOT NULL").select("id"), _now())
    return after.select("id", *(c for c, *_ in _RESETS), "deleted_at")


@query("""SELECT id, is_duplicate AND duplicate_confidence_score IS NOT NULL AS is_duplicate, coalesce(is_duplicate AND duplicate_confidence_score IS NULL, false) AS duplicate_override FROM receipts""")
def after_override(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates without a score are none by a user's word."""
    r = table(spark, d, "receipts")
    return lifecycle.overridden(r, r.where("is_duplicate AND duplicate_confidence_score IS NULL").select("id")).select("id", "is_duplicate", "duplicate_override")


@query(f"""WITH {FIRST}, o AS (SELECT entity_id AS id, original FROM first_values WHERE entity_type = 'receipt' AND field_name = 'storeName')
  SELECT r.id, 'store_name' AS field_name, r.store_name AS old_value, o.original AS new_value FROM receipts r JOIN o USING (id) WHERE r.store_name IS DISTINCT FROM o.original""")
def edit_change_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a reset of the shop names would change."""
    r, h = _t(spark, d, "receipts", "receipt_edit_history")
    return edits.change_rows(r.select("id", "store_name"), edits.restored_receipts(r, h).select("id", "store_name"), "id", ["store_name"])


@query("""SELECT id AS user_id, coalesce(export_settings.decimal_separator, '.') AS decimal_separator, 'cents' AS amount_format, coalesce(export_settings.date_format, 'YYYY-MM-DD') AS date_format,
  coalesce(export_settings.include_currency, true) AS include_currency, false AS include_header FROM users""")
def settings_patched(spark: SparkSession, d: str) -> DataFrame:
    """Settings after a patch of two of their fields."""
    from tallyforge.sources.exports import DEFAULTS

    patch = F.struct(F.lit(None).cast("string").alias("decimal_separator"), F.lit("cents").alias("amount_format"), F.lit(None).cast("string").alias("date_format"), F.lit(None).cast("boolean").alias("include_currency"), F.lit(False).alias("include_header"))
    return table(spark, d, "users").select(F.col("id").alias("user_id"), *state_changes.patched_settings(F.col("export_settings"), patch, DEFAULTS))


# --- checks of numbers and texts ------------------------------------------------------------------


@query(f"""WITH {OCR}, seen AS (SELECT doc_id, list(v) AS vs FROM nums WHERE v IS NOT NULL GROUP BY 1),
  t AS (SELECT d.doc_id AS receipt_id, coalesce(s.vs, []) AS vs FROM documents d LEFT JOIN seen s USING (doc_id) WHERE d.text IS NOT NULL),
  totals AS (SELECT r.id AS receipt_id, t.vs, coalesce(total_amount = 0 OR len(list_filter(t.vs, lambda v: abs(v - abs(CAST(total_amount AS DOUBLE))) < 0.01)) > 0, false) AS total_found FROM receipts r JOIN t ON t.receipt_id = r.id),
  items AS (SELECT l.receipt_id, count(*) AS n, count(*) FILTER (NOT coalesce(price_per_unit = 0 OR len(list_filter(t.vs, lambda v: abs(v - abs(CAST(price_per_unit AS DOUBLE))) < 0.01)) > 0, false)) AS n_missing
    FROM line_items l JOIN t ON t.receipt_id = l.receipt_id WHERE item_type = 'product' GROUP BY 1)
  SELECT receipt_id, total_found, coalesce(n, 0) AS n_products, coalesce(n_missing, 0) AS n_missing, coalesce(n >= 3 AND ((NOT total_found AND n_missing >= n * 0.5) OR n_missing >= n * 0.8), false) AS unreliable,
    CASE WHEN coalesce(n >= 3 AND ((NOT total_found AND n_missing >= n * 0.5) OR n_missing >= n * 0.8), false) THEN 'LOW_IMAGE_QUALITY'
      ELSE array_to_string(list_concat(CASE WHEN total_found THEN [] ELSE ['OCR_MISMATCH:total'] END, CASE WHEN coalesce(n_missing, 0) = 0 THEN [] ELSE ['OCR_MISMATCH:unitPrice x' || n_missing] END), ';') END AS issues
  FROM totals LEFT JOIN items USING (receipt_id)""")
def receipts_cross_checked(spark: SparkSession, d: str) -> DataFrame:
    """Totals and prices of receipts looked for in a text of their own; the document of the same number stands for it."""
    r, li, docs = _t(spark, d, "receipts", "line_items", "documents")
    return ocr.cross_checked(r, li, docs.select(F.col("doc_id").alias("receipt_id"), "text"))


@query("""SELECT id, CASE WHEN total_price IS NULL OR (category IS NULL AND NOT coalesce(item_type = 'discount', false) AND total_price > round(CAST(amount AS DOUBLE) * CAST(price_per_unit AS DOUBLE), 2) + 0.02)
  THEN round(CAST(amount AS DOUBLE) * CAST(price_per_unit AS DOUBLE), 2) ELSE CAST(total_price AS DOUBLE) END AS total FROM line_items""")
def line_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals, computed where there is none; those of lines without a category held to the computed one."""
    return lifecycle.line_totals(table(spark, d, "line_items"), F.col("category").isNull())


@query("""SELECT doc_id, text IS NOT NULL AS ocr_used, coalesce(length(text), 0) AS n_ocr, 'simple' AS layout, coalesce(lang, 'eu') AS region, CASE WHEN source = 'scan-room' THEN 1 END AS retry_count FROM documents""")
def processing_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What is recorded of the reading of a text, with the defaults filled in."""
    meta = structures.processing_metadata(F.col("text"), F.lit(None).cast("string"), F.col("lang"), F.col("source") == "scan-room")
    return table(spark, d, "documents").select("doc_id", meta.alias("m")).select("doc_id", "m.*")


@query(r"""WITH s AS (SELECT doc_id, 1 AS engine, text FROM documents UNION ALL SELECT doc_id, 2, lower(text) || chr(10) || source FROM documents),
  l AS (SELECT doc_id, engine, generate_subscripts(ls, 1) AS pos, unnest(ls) AS raw FROM (SELECT doc_id, engine, string_split_regex(text, '\r?\n') AS ls FROM s WHERE text IS NOT NULL)),
  c AS (SELECT doc_id, engine, pos, regexp_replace(raw, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS line FROM l),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(line, '[\s\x{00A0}]+', ' ', 'g')) ORDER BY engine, pos) AS p FROM c WHERE line <> ''),
  m AS (SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY engine, pos)) AS merged, count(*) AS n_lines FROM k WHERE p = 1 GROUP BY 1),
  n AS (SELECT doc_id, CAST(sum(length(text)) FILTER (engine = 1) AS BIGINT) AS n_first, CAST(sum(length(text)) FILTER (engine = 2) AS BIGINT) AS n_second FROM s GROUP BY 1)
  SELECT doc_id, merged, CAST(n_lines AS INTEGER) AS n_lines, n_first, n_second FROM m JOIN n USING (doc_id)""")
def ocr_engines_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of a text side by side: their merged lines (as a hash) and lengths. The second is the first in small letters and a line more."""
    docs = table(spark, d, "documents")
    two = docs.select("doc_id", F.lit(1).alias("engine"), "text").unionAll(docs.select("doc_id", F.lit(2), F.concat(F.lower("text"), F.lit("\n"), F.col("source"))))
    merged = text_lines.merged_texts(two, "doc_id", "text", "engine").select("doc_id", F.sha2("merged", 256).alias("merged"), "n_lines")
    sizes = two.groupBy(F.col("doc_id").alias("of")).agg(F.sum(F.when(F.col("engine") == 1, F.length("text"))).alias("n_first"), F.sum(F.when(F.col("engine") == 2, F.length("text"))).alias("n_second"))
    return merged.join(sizes, F.col("doc_id") == F.col("of")).drop("of")


@query(r"""SELECT id, json_valid(coalesce(fenced, '')) AS first_try, json_valid(regexp_replace(regexp_replace(trim(fenced), '^```[a-zA-Z]*\s*', ''), '\s*```$', '')) AS second_try
  FROM (SELECT id, CASE WHEN id % 2 = 0 THEN '```json' || chr(10) || metadata || chr(10) || '```' ELSE metadata END AS fenced FROM processing_errors WHERE metadata IS NOT NULL)""")
def json_second_try(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text is JSON as it is, and without a fence of code around it. Every other text gets one first."""
    e = table(spark, d, "processing_errors").where("metadata IS NOT NULL")
    fenced = e.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n"), "metadata", F.lit("\n```"))).otherwise(F.col("metadata")).alias("t"))
    return fenced.select("id", structures.is_json(F.col("t")).alias("first_try"), structures.is_json(text.without_code_fence(F.col("t"))).alias("second_try"))


@query("""SELECT id, CASE WHEN p LIKE '/%' OR p LIKE 'uploads/%' THEN p ELSE 'uploads/' || p END AS path FROM (SELECT id, CASE id % 3 WHEN 0 THEN original_image_url WHEN 1 THEN 'uploads/' || original_file_name ELSE original_file_name END AS p FROM receipt_uploads)""")
def stored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Stored names of three kinds as paths: absolute, below the folder already, bare."""
    stored = F.when(F.col("id") % 3 == 0, F.col("original_image_url")).when(F.col("id") % 3 == 1, F.concat(F.lit("uploads/"), "original_file_name")).otherwise(F.col("original_file_name"))
    return table(spark, d, "receipt_uploads").select("id", text.path_of(stored).alias("path"))


@query("""WITH t AS (SELECT id, strftime(transaction_date, '%Y-%m-%d') AS day, CASE WHEN id % 2 = 0 THEN strftime(transaction_date, '%H:%M:%S') ELSE '' END AS time FROM receipts),
  s AS (SELECT *, TRY_CAST(substr(day, 1, 4) || '-' || substr(day, 9, 2) || '-' || substr(day, 6, 2) AS DATE) AS swapped, CAST(day AS DATE) AS d FROM t)
  SELECT id, CAST(day || ' ' || coalesce(nullif(time, ''), '00:00:00') AS TIMESTAMP) AS moment, CASE WHEN d > DATE '2023-03-02' AND swapped <= DATE '2023-03-02' THEN swapped ELSE d END AS day FROM s""")
def receipt_moments(spark: SparkSession, d: str) -> DataFrame:
    """Day and time of day as one moment, and days in the future with day and month exchanged; today is 2023-03-01."""
    r = table(spark, d, "receipts")
    time = F.when(F.col("id") % 2 == 0, F.date_format("transaction_date", "HH:mm:ss")).otherwise("")
    day = F.to_date("transaction_date")
    return r.select("id", structures.day_time(F.date_format("transaction_date", "yyyy-MM-dd"), time).alias("moment"), structures.not_in_future(day, F.lit("2023-03-01").cast("date")).alias("day"))


@query("""SELECT vec_id, CAST(sum(CASE WHEN a > b THEN CASE WHEN i = 0 THEN CAST(-1 AS HUGEINT) * (CAST(1 AS HUGEINT) << 63) ELSE CAST(1 AS HUGEINT) << (63 - i) END ELSE 0 END) AS BIGINT) AS bits
  FROM (SELECT vec_id, i, g[(i // 8) * 9 + i % 8 + 1] AS a, g[(i // 8) * 9 + i % 8 + 2] AS b FROM (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS g FROM embeddings), range(64) x(i)) GROUP BY 1""")
def difference_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Bits of neighbouring values in grids of 8 by 9, made of embeddings."""
    grid = F.concat("embedding", F.slice("embedding", 1, 8))
    return table(spark, d, "embeddings").select("vec_id", structures.difference_bits(grid).alias("bits"))


# --- boxes ----------------------------------------------------------------------------------------


@query(f"""WITH {BOXES}, c AS (SELECT image_id, box_no, confidence, greatest(0, least(1000, x)) AS l, greatest(0, least(1000, y)) AS t, greatest(0, least(1000, x + width)) AS r, greatest(0, least(1000, y + height)) AS b FROM boxes)
  SELECT image_id, box_no, l AS x, t AS y, r - l AS width, b - t AS height FROM c WHERE r > l AND b > t""")
def clamped_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by their corners, held within the picture."""
    box = structures.clamped_box(F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"), F.col("x"))
    return made_boxes(spark, d).select("image_id", "box_no", box.alias("b")).where("b IS NOT NULL").select("image_id", "box_no", "b.*")


@query(f"""WITH {BOXES}, p AS (SELECT image_id, box_no, confidence, greatest(0, x * 1.6 - 40) AS x1, greatest(0, y * 1.2 - 40) AS y1, least(1600, (x + width) * 1.6) AS x2, least(1200, (y + height) * 1.2) AS y2 FROM boxes)
  SELECT image_id, box_no, CAST(round_even(x1 / 1600 * 1000, 0) AS INTEGER) AS x, CAST(round_even(y1 / 1200 * 1000, 0) AS INTEGER) AS y, CAST(round_even((x2 - x1) / 1600 * 1000, 0) AS INTEGER) AS width, CAST(round_even((y2 - y1) / 1200 * 1000, 0) AS INTEGER) AS height
  FROM p WHERE x2 - x1 >= 1 AND y2 - y1 >= 1 AND (x2 - x1) * (y2 - y1) / 1920000.0 <= 0.10""")
def detector_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Corners in pixels as boxes in thousandths, without those that hold more than a tenth of the picture."""
    b = made_boxes(spark, d)
    corners = b.select("image_id", "box_no", "confidence", (F.col("x") * 1.6 - 40).alias("x1"), (F.col("y") * 1.2 - 40).alias("y1"), ((F.col("x") + F.col("width")) * 1.6).alias("x2"), ((F.col("y") + F.col("height")) * 1.2).alias("y2"))
    return boxes.from_corners(corners, 1600, 1200, 0.10).select("image_id", "box_no", "x", "y", "width", "height")


@query(f"""WITH {BOXES} SELECT image_id, round(coalesce(avg(coalesce(CAST(confidence AS DOUBLE), 0)), 0), 9) AS mean_confidence, count(*) AS n FROM boxes GROUP BY 1""")
def box_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    return made_boxes(spark, d).groupBy("image_id").agg(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias("mean_confidence"), F.count("*").alias("n"))


@query(f"""WITH {BOXES} SELECT image_id, box_no, CAST(CASE WHEN turn <> 0 AND confidence >= 0.05 THEN (360 - turn) % 360 ELSE 0 END AS INTEGER) AS turned FROM (SELECT *, CAST(rotation * 90 AS INTEGER) % 360 AS turn FROM boxes)""")
def upright_turns(spark: SparkSession, d: str) -> DataFrame:
    degrees = (F.col("rotation") * 90).cast("int") % 360
    return made_boxes(spark, d).select("image_id", "box_no", structures.turn_back(degrees, F.col("confidence"), 0.05).cast("int").alias("turned"))


@query(f"""WITH {BOXES}, e AS (SELECT image_id, box_no, greatest(0, floor((x - width * 0.15) / 1000 * 1600)) AS l, greatest(0, floor((y - height * 0.15) / 1000 * 1200)) AS t,
    least(1600, ceil((x + width * 1.15) / 1000 * 1600)) AS r, least(1200, ceil((y + height * 1.15) / 1000 * 1200)) AS b FROM boxes)
  SELECT image_id, box_no, CAST(l AS DOUBLE) AS left, CAST(t AS DOUBLE) AS top, CAST(r - l AS DOUBLE) AS crop_width, CAST(b - t AS DOUBLE) AS crop_height FROM e WHERE r > l AND b > t""")
def box_pixels_wide(spark: SparkSession, d: str) -> DataFrame:
    return boxes.pixel_crops(made_boxes(spark, d), 1600, 1200, padding=0.15)


# --- jobs and errors --------------------------------------------------------------------------------


@query("""SELECT id, attempt, CAST(CASE attempt WHEN 1 THEN 0 WHEN 2 THEN 30 ELSE 60 END AS INTEGER) AS wait FROM receipts, range(1, 4) x(attempt) WHERE status IN ('failed', 'unreadable')""")
def job_attempts(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.retries(table(spark, d, "receipts").where("status IN ('failed', 'unreadable')").select("id")).select("id", F.col("attempt").cast("long").alias("attempt"), "wait")


@query("""SELECT id, CASE WHEN json_extract_string(m, '$.errorType') = 'RATE_LIMITED' THEN 0 WHEN json_extract_string(m, '$.cause.errorType') = 'RATE_LIMITED' THEN 1 WHEN json_extract_string(m, '$.cause.cause.errorType') = 'RATE_LIMITED' THEN 2
    WHEN json_extract_string(m, '$.cause.cause.cause.errorType') = 'RATE_LIMITED' THEN 3 WHEN json_extract_string(m, '$.cause.cause.cause.cause.errorType') = 'RATE_LIMITED' THEN 4 END AS depth
  FROM (SELECT id, CASE id % 3 WHEN 0 THEN metadata WHEN 1 THEN '{"cause":' || metadata || '}' ELSE '{"message":"x","cause":{"cause":{"cause":{"cause":{"cause":' || metadata || '}}}}}' END AS m FROM processing_errors)""")
def rate_limit_causes(spark: SparkSession, d: str) -> DataFrame:
    """How deep the limiter is named in an error: as it is, wrapped once, and wrapped too often."""
    m = F.col("metadata")
    deep = F.concat(F.lit('{"message":"x","cause":{"cause":{"cause":{"cause":{"cause":'), m, F.lit("}}}}}"))
    wrapped = F.when(F.col("id") % 3 == 0, m).when(F.col("id") % 3 == 1, F.concat(F.lit('{"cause":'), m, F.lit("}"))).otherwise(deep)
    return table(spark, d, "processing_errors").select("id", jobs.cause_depth(wrapped).alias("depth"))


LIMITER = """RECURSIVE windows(key, start) AS (
  SELECT event_type, min(ts) FROM events WHERE event_type IS NOT NULL GROUP BY 1
  UNION ALL SELECT w.key, (SELECT min(ts) FROM events e WHERE e.event_type = w.key AND e.ts >= w.start + INTERVAL 24 HOURS) FROM windows w WHERE w.start IS NOT NULL),
held AS (SELECT key, start FROM windows WHERE start IS NOT NULL),
placed AS (SELECT e.event_type AS key, e.event_id, e.ts, h.start AS window_start, row_number() OVER (PARTITION BY e.event_type, h.start ORDER BY e.ts, e.event_id) AS place
  FROM events e ASOF JOIN held h ON h.key = e.event_type AND e.ts >= h.start),
admitted AS (SELECT key, event_id, ts, place <= {most} AS allowed, CAST(least(place, {most}) AS INTEGER) AS used, window_start FROM placed)"""


@query(f"WITH {LIMITER.format(most=60)} SELECT * FROM admitted")
def rate_limiter_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    return jobs.limited_batch(table(spark, d, "events"), "event_type", 60, "24h")


@query(f"""WITH {LIMITER.format(most=60)}, last AS (SELECT key, arg_max(used, (ts, event_id)) AS used, max(window_start) AS start FROM admitted GROUP BY 1)
  SELECT key, CASE WHEN start + INTERVAL 24 HOURS <= TIMESTAMP '2024-01-31 00:00:00' THEN 60 ELSE greatest(0, 60 - used) END AS remaining,
    CASE WHEN start + INTERVAL 24 HOURS <= TIMESTAMP '2024-01-31 00:00:00' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE start + INTERVAL 24 HOURS END AS reset_at,
    CASE WHEN start + INTERVAL 24 HOURS <= TIMESTAMP '2024-01-31 00:00:00' THEN true ELSE used < 60 END AS available FROM last""")
def limiter_status(spark: SparkSession, d: str) -> DataFrame:
    """What the limiter has left for each key at the end of January 2024."""
    admitted = jobs.limited_batch(table(spark, d, "events"), "event_type", 60, "24h")
    return jobs.limiter_status(admitted, 60, "24h", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
