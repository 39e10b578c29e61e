"""Versioned text: proposals, drift, undo, history, exclusions, publishing.

Every operation is a plan, a table with one row per target and a status, and
a step that makes the next table out of the plan. Nothing is updated in place:
the next table is the survivors and the changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")))


def drift_plan(targets: DataFrame, proposals: DataFrame) -> DataFrame:
    """targets (key, text), proposals (key, before, after) -> proposals with ``status``.

    no-proposal: nothing to write. missing-caption: gone, though there was a text
    before. already-applied: it says so already. drifted: it says neither. Else
    would-write. Texts are compared without white space at their ends.
    """
    now = proposals.join(targets.select("key", F.col("text").alias("_now"), F.lit(True).alias("_there")), "key", "left")
    before, after = _clean(F.col("before")), _clean(F.col("after"))
    current = F.when(F.col("_there"), _clean(F.col("_now"))).otherwise(F.lit(""))
    status = (
        F.when((after == "") | (after == before), "no-proposal").when(F.col("_there").isNull() & (before != ""), "missing-caption")
        .when(current == after, "already-applied").when(current != before, "drifted").otherwise("would-write")
    )
    return now.withColumn("status", status).drop("_now", "_there")


def applied(targets: DataFrame, plan: DataFrame) -> DataFrame:
    """The targets after the plan's writes."""
    writes = plan.where("status = 'would-write'").select("key", _clean(F.col("after")).alias("text"))
    return targets.select("key", "text").join(writes, "key", "left_anti").unionByName(writes)


def undo_plan(targets: DataFrame, proposals: DataFrame) -> DataFrame:
    """The plan that takes proposals back: the texts change places, and a text that
    was not there before is removed, if the target still says what was written."""
    created = _clean(F.col("before")) == ""
    back = drift_plan(targets, proposals.where(~created).select("key", F.col("after").alias("before"), F.col("before").alias("after")))
    gone = proposals.where(created).join(targets.select("key", F.col("text").alias("_now"), F.lit(True).alias("_there")), "key", "left")
    wrote = _clean(F.col("after"))
    status = F.when(wrote == "", "no-proposal").when(F.col("_there").isNull(), "already-applied").when(_clean(F.col("_now")) != wrote, "drifted").otherwise("would-remove")
    gone = gone.select("key", wrote.alias("before"), F.lit("").alias("after"), status.alias("status"))
    return back.select("key", "before", "after", "status").unionByName(gone)


def undone(targets: DataFrame, plan: DataFrame) -> DataFrame:
    removed = plan.where("status = 'would-remove'").select("key")
    return applied(targets, plan).join(removed, "key", "left_anti")


def replay(report: DataFrame, targets: DataFrame, *, statuses: tuple[str, ...] = ("would-write",), pattern: str = "%") -> DataFrame:
    """The plan of a stored report: rows of the admitted statuses and keys, tested anew."""
    kept = report.where(F.col("status").isin(*statuses) & F.col("key").cast("string").like(pattern))
    return drift_plan(targets, kept.drop("status"))


def push_history(edits: DataFrame, limit: int = 10) -> DataFrame:
    """edits (key, at, order, text) -> history (key, seq, at, text): empty texts and
    repeats of the newest entry are not recorded, seq counts all that ever were, and
    the newest ``limit`` stay."""
    order = Window.partitionBy("key").orderBy("at", "order")
    text = _clean(F.col("text"))
    full = edits.withColumn("text", text).where("text <> ''")
    fresh = full.withColumn("_last", F.lag("text").over(order)).where(~F.col("_last").eqNullSafe(F.col("text")))
    numbered = fresh.withColumn("seq", F.row_number().over(order))
    last = F.max("seq").over(Window.partitionBy("key"))
    return numbered.withColumn("_top", last).where(F.col("seq") > F.col("_top") - max(1, limit)).select("key", "seq", "at", "text")


def versions(rungs: list[tuple[str, DataFrame]], history: DataFrame) -> DataFrame:
    """(key, badge, place, text): the rungs in order, then history, newest first."""
    out = None
    for i, (name, rows) in enumerate(rungs):
        part = rows.select("key", F.lit(name).alias("badge"), F.lit(i).alias("place"), "text")
        out = part if out is None else out.unionByName(part)
    past = history.select("key", F.concat(F.lit("revised@"), "seq").alias("badge"), (F.lit(1_000_000) - F.col("seq")).cast("int").alias("place"), "text")
    return out.unionByName(past)


def exclude(ledger: DataFrame, moves: DataFrame) -> DataFrame:
    """ledger and moves (rel, at, moved array): the first ``at`` stands, moved is united."""
    each = ledger.unionByName(moves).select("rel", "at", F.explode_outer("moved").alias("m"))
    return each.groupBy("rel").agg(F.min("at").alias("at"), F.sort_array(F.collect_set("m")).alias("moved"))


def publish_plan(source: DataFrame, destination: DataFrame) -> DataFrame:
    """source and destination (rel, content) -> rel, status."""
    s = source.select("rel", F.md5(F.coalesce("content", F.lit(""))).alias("_s"), F.lit(True).alias("_has_s"))
    d = destination.select("rel", F.md5(F.coalesce("content", F.lit(""))).alias("_d"), F.lit(True).alias("_has_d"))
    status = F.when(F.col("_has_s").isNull(), "would-remove").when(F.col("_has_d").isNull(), "would-create").when(F.col("_s") == F.col("_d"), "identical").otherwise("would-overwrite")
    return s.join(d, "rel", "full").select("rel", status.alias("status"))


def publish_revert(plan: DataFrame) -> DataFrame:
    """What takes a publish back: created goes, overwritten and removed come back."""
    back = F.when(F.col("status") == "would-create", "remove").when(F.col("status") == "would-overwrite", "restore").when(F.col("status") == "would-remove", "recreate")
    return plan.select("rel", back.alias("action")).where("action is not null")


def overwrite_by_key(old: DataFrame, new: DataFrame, keys: list[str], empty: Column | None = None) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and ``new`` without the empty ones."""
    kept = new if empty is None else new.where(~empty)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(kept)


def up_to_date(derived: DataFrame, stamps: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """stamps without a derived row of the same signature: the work that is left."""
    return stamps.join(derived.select(*keys, *signature), [*keys, *signature], "left_anti")
