"""References to records that do not exist (problem 5).

A reference fails when its target is missing, was deleted by the time the referring row was
stored, or was stored later than the referring row. What is checked are not rows but counts:

1. references are pre-aggregated per key and period (the month of the referring row, with the
   earliest and latest moment in it) in one pass over each table, so a key that a third of the
   rows name costs one row a period;
2. keys above ``heavy_share`` of all references of their field are *heavy*; at most
   ``1 / heavy_share`` can be, and they look their target up in a broadcast table of at most that
   many rows. The counts of all other keys are joined to the targets by a shuffle on the key; none
   of them can overload a task, as a key has one row a period;
3. both parts are put together: the counts that fail as a whole, and those that may fail in part,
   as their target was deleted or stored within the period.

The report needs rows only for the counts that fail in part. The rows themselves are those of the
failing keys, which are sent to the tables where they are few, else met in a shuffle in which heavy
keys are spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.storage import materialize

#: A key with more than this share of all references of its field is heavy.
HEAVY_SHARE = 1 / 2000
#: Below this count no key is heavy: a task takes such a group without trouble.
HEAVY_FLOOR = 5000
#: Failing keys (about 60 bytes each) that are sent to every task; more are shuffled.
FAILING_SENT = 200_000
#: Parts into which the rows of a heavy key are dealt where failing keys are shuffled.
SALTS = 64


@dataclass(frozen=True)
class Reference:
    """``field`` of ``table`` names rows of the table ``target`` by their ``id``."""

    table: str
    field: str
    target: str


REFERENCES = (
    Reference("line_items", "receipt_id", "receipts"),
    Reference("line_items", "parent_line_item_id", "line_items"),
    Reference("receipts", "duplicate_of_receipt_id", "receipts"),
)


def references(tables: dict[str, DataFrame], wanted: tuple[Reference, ...]) -> DataFrame:
    """(ref, ref_key, row_id, created): every reference that is not null; each table is read once."""
    parts = []
    for name in sorted({r.table for r in wanted}):
        keys = F.array(*(F.struct(F.lit(i).alias("ref"), F.col(r.field).alias("ref_key")) for i, r in enumerate(wanted) if r.table == name))
        parts.append(tables[name].select(F.inline(keys), F.col("id").alias("row_id"), F.col("created_at").alias("created")).where("ref_key IS NOT NULL"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def counted(refs: DataFrame) -> DataFrame:
    """(ref, ref_key, month, n, first, last): references per key and period; without a moment, a null period."""
    month = F.date_trunc("month", "created").alias("month")
    return refs.groupBy("ref", "ref_key", month).agg(F.count("*").alias("n"), F.min("created").alias("first"), F.max("created").alias("last"))


def heavy_keys(counts: DataFrame, share: float, floor: int) -> list[tuple[int, int]]:
    """(ref, key) with more than ``share`` of all references of a field, and more than ``floor``; at most ``1 / share`` a field."""
    totals = {r.ref: r.n for r in counts.groupBy("ref").agg(F.sum("n").alias("n")).collect()}
    bound = F.lit(None).cast("double")
    for ref, n in totals.items():
        bound = F.when(F.col("ref") == ref, float(max(floor, share * n))).otherwise(bound)
    per_key = counts.where(F.col("n") > 0).groupBy("ref", "ref_key").agg(F.sum("n").alias("n"))
    return [(r.ref, r.ref_key) for r in per_key.where(F.col("n") > bound).collect()]


def _is_heavy(heavy: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for ref in sorted({r for r, _ in heavy}):
        out = out | ((F.col("ref") == ref) & F.col("ref_key").isin([k for r, k in heavy if r == ref]))
    return out


def _failure(created: Column) -> Column:
    """Why a reference made at ``created`` fails, from the columns of its target; null where it does not."""
    return (
        F.when(F.col("target_id").isNull(), "missing")
        .when(F.col("target_deleted") <= created, "deleted")
        .when(F.col("target_created") > created, "late")
    )


class OrphanCheck:
    """The counts of all references of ``tables`` next to their targets, worked out once."""

    def __init__(self, tables: dict[str, DataFrame], wanted: tuple[Reference, ...] = REFERENCES, heavy_share: float = HEAVY_SHARE, heavy_floor: int = HEAVY_FLOOR) -> None:
        self.wanted = wanted
        self.refs = references(tables, wanted)
        counts = materialize(counted(self.refs), "reference-counts")
        self.heavy = heavy_keys(counts, heavy_share, heavy_floor)
        parts = []
        for name in sorted({r.target for r in wanted}):
            of_target = [i for i, r in enumerate(wanted) if r.target == name]
            # the id is the targets' key; the grouping only settles what a repeated id means
            targets = tables[name].where("id IS NOT NULL").groupBy(F.col("id").alias("target_id")).agg(
                F.min("deleted_at").alias("target_deleted"), F.min("created_at").alias("target_created")
            )
            mine = counts.where(F.col("ref").isin(of_target))
            heavy = [(r, k) for r, k in self.heavy if r in of_target]
            met = F.col("ref_key") == F.col("target_id")
            if heavy:
                few = targets.where(F.col("target_id").isin(sorted({k for _, k in heavy})))
                parts.append(mine.where(_is_heavy(heavy)).join(F.broadcast(few), met, "left"))
                mine = mine.where(~_is_heavy(heavy))
            parts.append(mine.join(targets, met, "left"))
        checked = parts[0]
        for p in parts[1:]:
            checked = checked.unionAll(p)
        # with time a target first is yet to come, then there, then deleted: what holds at both ends of a period holds within
        ends = checked.select("*", _failure(F.col("first")).alias("at_first"), _failure(F.col("last")).alias("at_last"))
        whole = F.when(F.col("at_first") == F.col("at_last"), F.col("at_first"))
        columns = ["ref", "ref_key", "month", "n", "target_id", "target_deleted", "target_created"]
        self.failing = materialize(ends.where("at_first IS NOT NULL OR at_last IS NOT NULL").select(*columns, whole.alias("kind")), "failing-keys")

    def _named(self, rows: DataFrame, *columns: str) -> DataFrame:
        names = F.lit(None).cast("struct<ref_table:string,ref_field:string>")
        for i, r in enumerate(self.wanted):
            names = F.when(F.col("ref") == i, F.struct(F.lit(r.table).alias("ref_table"), F.lit(r.field).alias("ref_field"))).otherwise(names)
        return rows.select(F.inline(F.array(names)), *columns)

    def _rows(self, failing: DataFrame) -> DataFrame:
        """The references of these keys and periods that fail: (ref, row_id, ref_month, ref_kind)."""
        refs = self.refs.withColumn("month", F.date_trunc("month", "created"))
        few = failing.count() <= FAILING_SENT
        salted = F.lit(False) if few else _is_heavy(self.heavy)
        refs = refs.withColumn("salt", F.when(salted, F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).otherwise(0)).alias("r")
        salts = F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        keys = failing.withColumn("salt", F.explode(salts))
        keys = (F.broadcast(keys) if few else keys).alias("k")
        same = [F.col(f"r.{c}") == F.col(f"k.{c}") for c in ("ref", "ref_key", "salt")]
        met = refs.join(keys, [*same, F.col("r.month").eqNullSafe(F.col("k.month"))])
        kind = _failure(F.col("created")).alias("ref_kind")
        return met.select(F.col("r.ref").alias("ref"), "row_id", F.date_format("created", "yyyy-MM").alias("ref_month"), kind).where("ref_kind IS NOT NULL")

    def references(self) -> DataFrame:
        """Every failing reference as (ref_table, ref_field, row_id, ref_month, ref_kind).

        Null references are no references. A null ``created_at`` of the referring row gives a null
        month and can only be ``missing``; a null ``deleted_at`` or ``created_at`` of the target never
        makes a reference fail. Repeated referring rows are reported once each. Should a target id
        be repeated, the earliest deletion and earliest storing count. Empty tables give no rows.
        """
        return self._named(self._rows(self.failing), "row_id", "ref_month", "ref_kind")

    def counts(self) -> DataFrame:
        """(ref_table, ref_field, ref_month, ref_kind, n_refs); rows are read only for the keys that fail in part of a period."""
        month = F.date_format("month", "yyyy-MM").alias("ref_month")
        whole = self.failing.where("kind IS NOT NULL").select("ref", month, F.col("kind").alias("ref_kind"), "n")
        part = self._rows(self.failing.where("kind IS NULL")).groupBy("ref", "ref_month", "ref_kind").agg(F.count("*").alias("n"))
        both = whole.unionAll(part).groupBy("ref", "ref_month", "ref_kind").agg(F.sum("n").alias("n_refs"))
        return self._named(both, "ref_month", "ref_kind", "n_refs")
