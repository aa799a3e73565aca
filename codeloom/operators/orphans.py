"""References to records that do not exist: pending-orphan state kept by increments.

State is two keyed tables. The *parent index* has one row per parent key: the time from which it exists (null while it
doesn't) and the time of its last deletion, if any. *Pending* has one row per reference that found no parent at its own
time, with the time at which an arriving parent resolved it (null while it waits). An increment brings new references,
new parents and deletions:

1. parents merge into the index: the earliest time after the key's last deletion wins, so late rows count from their own
   time, not their arrival, and rows from before a deletion don't count;
2. new references probe the index;
3. arriving parents meet the pending references only: one that turns out to have existed in time withdraws the orphan,
   a later one resolves it;
4. a deletion reopens the references that relied on its key, as if the parent had begun to exist with its first row
   after the deletion; they are looked up among the references so far, the only time these are read again.

A reference is a row (ref_id, endpoint, key, at). Null keys are no references. A reference without a time can't be
shown to be in time, so it is an orphan; a parent without a time never existed at any time, a deletion without a time
never happened. Repeated references count once. Empty tables give empty state.

Increments are bounded by time. A deletion that is delivered after later rows of its key were merged finds their first
only, so such rows are lost to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import canonical_id, hot_keys, lookup
from codeloom.session import cut
from codeloom.sources.versions import Versions

PARENTS = "key string, first_at timestamp_ntz, deleted_at timestamp_ntz"
PENDING = "ref_id string, endpoint string, key string, at timestamp_ntz, resolved_at timestamp_ntz"
SNAPSHOTS = "endpoint string, month string, orphans bigint, waiting bigint, resolved bigint, as_of timestamp_ntz"


@dataclass(frozen=True)
class OrphanState:
    """parents: key, first_at, deleted_at. pending: ref_id, endpoint, key, at, resolved_at. None stands for no rows.

    deletes: whether the index may hold deleted keys.
    """

    parents: DataFrame | None = None
    pending: DataFrame | None = None
    deletes: bool = False


def references(edges: DataFrame) -> DataFrame:
    """Both endpoints of every edge as references. Extra columns are ignored."""
    ends = F.explode(
        F.array(
            F.struct(F.lit("from").alias("endpoint"), F.col("from_uuid").alias("raw")),
            F.struct(F.lit("to").alias("endpoint"), F.col("to_uuid").alias("raw")),
        )
    ).alias("end")
    return (
        edges.select(F.col("uuid").alias("ref_id"), F.col("created_at").cast("timestamp_ntz").alias("at"), ends)
        .where(F.col("end.raw").isNotNull())
        .select("ref_id", "end.endpoint", canonical_id("end.raw").alias("key"), "at")
    )


def parents(nodes: DataFrame) -> DataFrame:
    """(key, first_at) of every row of an entity that has a time."""
    rows = nodes.select(canonical_id("uuid").alias("key"), F.col("created_at").cast("timestamp_ntz").alias("first_at"))
    return rows.where("key is not null and first_at is not null")


def deletions(audit: DataFrame) -> DataFrame:
    """(key, deleted_at) of the rows of an audit log that delete an entity."""
    plain = F.regexp_replace(F.lower("action"), r"^\s+|\s+$", "")
    rows = audit.where((F.col("entity_type") == "node") & F.col("timestamp").isNotNull() & (plain == "delete_entity"))
    return rows.select(canonical_id("entity_uuid").alias("key"), F.col("timestamp").cast("timestamp_ntz").alias("deleted_at")).where("key is not null")


def merge_parents(state: OrphanState, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index after rows (key, first_at) and deletions (key, deleted_at); combined where the rows are."""
    known, never = state.parents, F.lit(None).cast("timestamp_ntz").alias("deleted_at")
    if gone is None and not state.deletes:
        rows = new if known is None else new.unionByName(known.select("key", "first_at"))
        return rows.groupBy("key").agg(F.min("first_at").alias("first_at")).select("key", "first_at", never)
    dead = known.where("deleted_at is not null").select("key", "deleted_at") if state.deletes else None
    if gone is not None:
        dead = (gone if dead is None else gone.unionByName(dead)).groupBy("key").agg(F.max("deleted_at").alias("deleted_at"))
    rows = new if known is None else new.unionByName(known.where("first_at is not null").select("key", "first_at"))
    # Of a key that was deleted, only rows from after its deletion count.
    alive = lookup(rows, dead, "key", ["deleted_at"]).where("deleted_at is null or first_at > deleted_at")
    return alive.groupBy("key").agg(F.min("first_at").alias("first_at")).join(dead, "key", "full").select("key", "first_at", "deleted_at")


def step(state: OrphanState, new_references: DataFrame, new_parents: DataFrame, hot: Sequence | None = None, gone: DataFrame | None = None, so_far: DataFrame | None = None) -> OrphanState:
    """The state after one increment.

    hot: the hot keys of the references, by default found here. gone: deletions (key, deleted_at); so_far, needed with
    them: all references up to now, the new ones included.
    """
    hot = hot_keys(new_references, "key") if hot is None else hot
    index = merge_parents(state, new_parents, gone)
    too_late = ~F.coalesce(F.col("first_at") <= F.col("at"), F.lit(False))
    keys = ["ref_id", "endpoint", "key", "at"]
    if gone is not None:
        # What relied on a deleted key is judged anew, with everything else of that key.
        dead = cut(gone.select("key").distinct())
        again = so_far.join(dead, "key", "left_semi")
        new_references = new_references.join(dead, "key", "left_anti").select(*keys).unionByName(again.select(*keys))
    probed = lookup(new_references, index, "key", ["first_at"], hot).where(too_late)
    pending = probed.select(*keys, F.col("first_at").alias("resolved_at"))
    if state.pending is not None:
        # A parent that arrives now resolves what waits; one that dates from before withdraws the orphan.
        waiting = state.pending if gone is None else state.pending.join(dead, "key", "left_anti").select(*state.pending.columns)
        arrived = new_parents.groupBy("key").agg(F.min("first_at").alias("first_at"))
        met = lookup(waiting, arrived, "key", ["first_at"], hot).where(too_late)
        pending = pending.unionByName(met.select(*keys, F.least("resolved_at", "first_at").alias("resolved_at")))
    return OrphanState(index, pending.groupBy(*keys).agg(F.min("resolved_at").alias("resolved_at")), state.deletes or gone is not None)


def counts(state: OrphanState) -> DataFrame:
    """Snapshot: orphans per endpoint and month of the reference, and how many of them still wait."""
    return state.pending.groupBy("endpoint", F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orphans"),
        F.count_if(F.col("resolved_at").isNull()).alias("waiting"),
        F.count_if(F.col("resolved_at").isNotNull()).alias("resolved"),
    )


def _part(column: str, low: str | None, high: str | None):
    """The rows from low on and before high, as plain comparisons that reach the Parquet reader. A row without a time
    belongs to the last increment."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    inside = None if low is None else F.col(column) >= at(low)
    if high is not None:
        inside = F.col(column) < at(high) if inside is None else inside & (F.col(column) < at(high))
    elif inside is not None:
        inside = inside | F.col(column).isNull()
    return F.lit(True) if inside is None else inside


def run_increments(
    edges: DataFrame, nodes: DataFrame, cuts: Sequence[str] = (), audit: DataFrame | None = None, kept: Versions | None = None, snapshots: bool = False, until: str | None = None
) -> OrphanState:
    """Apply the rows in increments bounded by the given times; each reads both tables once, for its own rows only.

    kept: where the state is kept. A version is written after each increment, and the state of the current version, if
    there is one, is what the first increment starts from; the first of the cuts is then where that state ended. Without
    it the state is cut into the shared folder. audit: a log whose deletions count. snapshots: write the counts after
    each increment beside the kept state, for history(). until: leave out rows from then on.
    """
    state, bounds = OrphanState(), [None, *cuts, until]

    def again(deletes: bool) -> OrphanState:
        return OrphanState(kept.read("parents", PARENTS), kept.read("pending", PENDING), deletes)

    if kept is not None and kept.current():
        state, bounds = again(True), [*cuts, until]
    for low, high in zip(bounds, bounds[1:]):
        new = cut(references(edges.where(_part("created_at", low, high))))
        came = parents(nodes.where(_part("created_at", low, high)))
        gone = so_far = None
        if audit is not None:
            gone = deletions(audit.where(_part("timestamp", low, high)))
            so_far = references(edges.where(_part("created_at", None, high)))
        if gone is None and not state.deletes:
            # The first row of a key is all that counts, unless deletions come between its rows.
            came = came.groupBy("key").agg(F.min("first_at").alias("first_at"))
        state = step(state, new, cut(came), None, gone, so_far)
        if kept is not None:
            kept.write({"parents": state.parents, "pending": state.pending})
            state = again(state.deletes)
            if snapshots:
                counts(state).write.mode("overwrite").parquet(f"{kept.folder}/snapshots/as_of={high or 'end'}")
        elif high is not None:
            state = OrphanState(cut(state.parents), cut(state.pending), state.deletes)
    return state


def history(kept: Versions) -> DataFrame:
    """(as_of, endpoint, month, orphans, waiting, resolved): the snapshots taken so far; as_of is null for one without end."""
    rows = kept.spark.read.schema(SNAPSHOTS.replace("as_of timestamp_ntz", "as_of string")).parquet(f"{kept.folder}/snapshots")
    return rows.select(F.expr("try_cast(as_of as timestamp_ntz)").alias("as_of"), "endpoint", "month", "orphans", "waiting", "resolved")
