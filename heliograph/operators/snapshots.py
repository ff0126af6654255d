"""Current state from change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from heliograph.operators.blocks import MOST_ROWS, time_blocks


def latest_snapshot(
    changes: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str], op: str = "op"
) -> DataFrame:
    """Entities that exist after all changes, last write wins.

    `put` stores a whole document, `patch` overwrites the fields it carries (non-null), `delete`
    removes. A patch without a document is refused. So a field is the last patch after the last put,
    or else the put's own value; and an entity exists if its last put is after its last delete. All
    of these are maxima, so a key with most of the changes combines inside the tasks.
    """
    return snapshot_of(snapshot_state(changes, keys, fields, order, op), keys, fields, order)


def snapshot_state(
    changes: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str], op: str = "op"
) -> DataFrame:
    """All that a snapshot depends on, one row per entity, deleted ones too; states of different changes merge.

    The last put, the last delete, and per field the last patch.
    """
    at = F.struct(*order)
    put, patch, gone = (F.col(op) == name for name in ("put", "patch", "delete"))
    return changes.groupBy(*keys).agg(
        F.max(F.when(put, F.struct(*order, *fields))).alias("_put"),
        F.max(F.when(gone, at)).alias("_gone"),
        *[F.max(F.when(patch & F.col(f).isNotNull(), F.struct(*order, f))).alias(f"_{f}") for f in fields],
        F.max(F.when(patch, at)).alias("_patched"),
    )


def merge_snapshot_states(one: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after the changes of both, whichever came first."""
    both = one.unionByName(other)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])


def snapshot_of(state: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Entities that exist, from their state."""
    def position(struct: str):
        return F.struct(*[F.col(f"{struct}.{o}").alias(o) for o in order])

    alive = F.col("_put").isNotNull() & (F.col("_gone").isNull() | (position("_put") > F.col("_gone")))
    values = [
        F.when(F.col(f"_{f}").isNotNull() & (position(f"_{f}") > position("_put")), F.col(f"_{f}.{f}"))
        .otherwise(F.col(f"_put.{f}"))
        .alias(f)
        for f in fields
    ]
    last = F.greatest(position("_put"), F.col("_patched"))
    return state.filter(alive).select(*keys, *values, *[last[o].alias(o) for o in order])


def with_state_before(
    changes: DataFrame, key: str, fields: Sequence[str], order: Sequence[str], op: str = "op",
    block_seconds: int = 86_400, block_rows: int = MOST_ROWS,
) -> DataFrame:
    """Changes with what they met: `existed`, and `before` with the fields' values right before (null where
    nothing existed).

    That depends on the order, so it takes windows; they cover one time block of one entity, cut further where it
    is busy. A block is summed up by the last value that it leaves in each field, and what it
    starts from, the last value of the blocks before, becomes its first row. `order` begins with the time.
    """
    put, patch, gone = (F.col(op) == name for name in ("put", "patch", "delete"))
    types = {f.name: f.dataType for f in changes.schema}
    # What a change does to a field: a struct holds the new value, null leaves the field alone.
    effects = {f"_set_{f}": F.when(put | (patch & F.col(f).isNotNull()), F.struct(F.col(f).alias("v"))).when(gone, F.struct(F.lit(None).cast(types[f]).alias("v"))) for f in fields}
    effects["_alive"] = F.when(put | gone, F.struct(put.alias("v")))
    rows = time_blocks(changes, key, order[0], block_seconds, block_rows).select(*changes.columns, "_block", *[e.alias(c) for c, e in effects.items()], F.lit(False).alias("_entry"))
    left = rows.groupBy(key, "_block").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))).alias(c) for c in effects])
    by_block = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    entries = left.select(key, "_block", *[F.last(F.col(f"{c}.v"), ignorenulls=True).over(by_block).alias(c) for c in effects], F.lit(True).alias("_entry"))
    in_block = W.partitionBy(key, "_block").orderBy(F.col("_entry").desc(), *order).rowsBetween(W.unboundedPreceding, -1)

    def met(c: str) -> Column:
        return F.last(c, ignorenulls=True).over(in_block)

    found = rows.unionByName(entries, allowMissingColumns=True).select(
        *changes.columns, "_entry", F.coalesce(met("_alive")["v"], F.lit(False)).alias("existed"),
        F.struct(*[met(f"_set_{f}")["v"].alias(f) for f in fields]).alias("_met"),
    )
    return found.filter(~F.col("_entry")).select(*changes.columns, "existed", F.when(F.col("existed"), F.col("_met")).alias("before"))


def task_moves(changes: DataFrame, order: Sequence[str] = ("at", "seq")) -> DataFrame:
    """From the change log of tasks the moves, for the feed: patches of the status of tasks that existed, with
    the title and agent that the task had then. Each has an id of its own."""
    met = with_state_before(changes, "id", ["title", "status", "assignee_id"], order)
    moved = met.filter((F.col("op") == "patch") & F.col("existed") & F.col("status").isNotNull())
    return moved.select(F.concat_ws("-", "id", "seq").alias("id"), "before.title", "status", "before.assignee_id", F.col("at").alias("updated_at"))


def page_updates(changes: DataFrame, fields: Sequence[str], order: Sequence[str] = ("at", "seq")) -> DataFrame:
    """From the change log of pages (by `slug`) the updates, for the feed: every patch of a page that
    existed, with the page's title then and the names of the fields that the patch carries."""
    met = with_state_before(changes, "slug", fields, order)
    carried = F.filter(F.array(*[F.when(F.col(f).isNotNull(), f) for f in fields]), lambda f: f.isNotNull())
    return met.filter((F.col("op") == "patch") & F.col("existed")).select(
        F.concat_ws("-", "slug", "seq").alias("id"), "slug", "before.title", carried.alias("changed"), F.col("at").alias("updated_at")
    )


def deletions(changes: DataFrame) -> DataFrame:
    """From a change log the deletions, for the feed, whether or not there was something to delete."""
    return changes.filter("op = 'delete'").select("id", F.col("at").alias("deleted_at"))


def agent_presence(agents: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """Agents with their last heartbeat. A heartbeat puts an agent online; nothing takes it off."""
    beats = heartbeats.groupBy(F.col("agent_id").alias("id")).agg(F.max("at").alias("_beat"))
    return agents.join(beats, "id", "left").select(
        *[c for c in agents.columns if c not in ("status", "last_heartbeat")],
        F.when(F.col("_beat").isNotNull(), "online").otherwise(F.col("status")).alias("status"),
        F.greatest("_beat", "last_heartbeat").alias("last_heartbeat"),
    )
