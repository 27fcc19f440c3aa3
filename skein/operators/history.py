"""History of changing attributes as checkpoints and patches, and the validity periods folded from them.

An *event* says that from version ``seq`` on an entity has the given attributes (``live``), or has ended (not
``live``). The store keeps, for every run of ``every`` versions in which an entity changes, one checkpoint (the full
attributes as they stood before that run) and one patch per event, holding only the attributes that differ from the
state before. A patch slot is null for "unchanged" and a one-field struct for "now this value", which may be null.
Replaying starts at the nearest checkpoint, so no replay reads more than ``every`` patches.

All groups are keyed by entity and hold at most one event per version, however often updates repeat: repeats are
merged before the data are gathered by entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import clean_id, clean_label

EVERY = 4


def one_event_per_version(events: DataFrame, key: list[str], attrs: list[str]) -> DataFrame:
    """Of several events of an entity at one ``seq``: a live one before an end, then the highest ``prio``."""
    best = F.max_by(F.struct("live", *attrs), F.struct("live", "prio"))
    return events.groupBy(*key, "seq").agg(best.alias("e")).select(*key, "seq", "e.*")


def build_store(events: DataFrame, key: list[str], attrs: list[str], every: int = EVERY) -> DataFrame:
    """Checkpoint and patch rows: ``key, _bucket, seq, _kind (0 checkpoint, 1 patch), live, full, patch``.

    ``events`` has at most one row per key and ``seq``. Null attributes are values like others; a null ``seq`` sorts
    first and forms a bucket of its own; no events give an empty store.
    """
    state = F.when(F.col("live"), F.struct(*attrs))
    ev = events.select(*key, "seq", "live", F.floor(F.col("seq") / every).alias("_bucket"), state.alias("state"))
    w = Window.partitionBy(*key).orderBy("seq")
    ev = ev.withColumn("prev", F.last("state", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    opens = ~F.lag("_bucket").over(w).eqNullSafe(F.col("_bucket"))
    ev = ev.withColumn("opens", opens & F.col("prev").isNotNull())

    def slot(a: str):
        now, was = F.col(f"state.{a}"), F.col(f"prev.{a}")
        changed = F.col("prev").isNull() | ~now.eqNullSafe(was)
        return F.when(F.col("state").isNotNull() & changed, F.struct(now.alias("v"))).alias(a)

    patch, none = F.struct(*[slot(a) for a in attrs]), F.lit(False)
    change = F.struct(F.col("seq"), F.lit(1).alias("_kind"), F.col("live"), F.when(none, F.col("prev")).alias("full"), patch.alias("patch"))
    start = (F.col("_bucket") * every).cast(events.schema["seq"].dataType)
    point = F.struct(start.alias("seq"), F.lit(0).alias("_kind"), F.when(none, F.col("live")).alias("live"), F.col("prev").alias("full"), F.when(none, patch).alias("patch"))
    return ev.select(*key, "_bucket", F.inline(F.when(F.col("opens"), F.array(point, change)).otherwise(F.array(change))))


def replay(store: DataFrame, key: list[str], attrs: list[str]) -> DataFrame:
    """The state after every stored row: ``key, seq, _kind, live`` and the attributes, patches folded from the checkpoint."""
    w = Window.partitionBy(*key, "_bucket").orderBy("seq", "_kind").rowsBetween(Window.unboundedPreceding, 0)

    def fold(a: str):
        slot = F.when(F.col("full").isNotNull(), F.struct(F.col(f"full.{a}").alias("v"))).otherwise(F.col(f"patch.{a}"))
        return F.last(slot, True).over(w).getField("v").alias(a)

    return store.select(*key, "_bucket", "seq", "_kind", "live", *[fold(a) for a in attrs])


def save(store: DataFrame, path: str) -> None:
    """Write the store by run of versions, so that a point query reads the runs it needs."""
    store.write.mode("overwrite").partitionBy("_bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def state_at(store: DataFrame, key: list[str], attrs: list[str], seq: int, every: int = EVERY) -> DataFrame:
    """The attributes of every entity that is live at version ``seq``, each with ``seq`` of its last change.

    Of each entity only its latest run of versions up to ``seq`` is folded, from that run's checkpoint: at most
    ``every`` patches, however long its history. Rows with a null ``seq`` are older than all versions.
    """
    rows = store.where((F.col("_bucket") <= seq // every) | F.col("_bucket").isNull()).where((F.col("seq") <= seq) | F.col("seq").isNull())
    # a run counts once something happened in it; a checkpoint alone does not tell whether the entity has ended
    latest = F.max(F.when(F.col("_kind") == 1, F.coalesce(F.col("_bucket"), F.lit(-1)))).over(Window.partitionBy(*key))
    near = rows.withColumn("_latest", latest).where(F.coalesce(F.col("_bucket"), F.lit(-1)) == F.col("_latest")).drop("_latest")
    states = replay(near, key, attrs).where(F.col("_kind") == 1)
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("seq")))
    return states.withColumn("_r", last).where("_r = 1 and live").select(*key, "seq", *attrs)


def periods(store: DataFrame, key: list[str], attrs: list[str], identity: list[str]) -> DataFrame:
    """Longest runs with equal ``identity``: ``key, attrs (as at the start), seq_added, seq_removed (0 if still valid)``.

    A period ends where the next one starts; only after an entity's last live event does an end event count.
    """
    states = replay(store, key, attrs).where(F.col("_kind") == 1)
    w = Window.partitionBy(*key).orderBy("seq")
    ident = F.struct(*identity)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    live_later = F.max(F.when(F.col("live"), F.lit(True))).over(later)
    was = F.last(F.when(F.col("live"), ident), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marks = states.withColumn("more", live_later).withColumn("was", was)
    starts = F.col("live") & (F.col("was").isNull() | ~ident.eqNullSafe(F.col("was")))
    ends = ~F.col("live") & F.col("more").isNull() & F.col("was").isNotNull()
    marks = marks.where(starts | ends)
    return (
        marks.withColumn("seq_removed", F.coalesce(F.lead("seq").over(w), F.lit(0)))
        .where("live")
        .select(*key, *attrs, F.col("seq").alias("seq_added"), "seq_removed")
    )


ATTRS = ["snippet_id", "repo", "file_path", "qualname", "ordinal", "kind", "line_start", "line_end"]
PLACE = ["snippet_id", "file_path", "qualname", "ordinal"]
KEY = ["lineage_id", "lone"]


def snippet_events(snippets: DataFrame, versions: DataFrame) -> DataFrame:
    """Events of each lineage from the row updates of the store.

    A row's latest ``exported_at`` tells its state (ties: the update that closes it, then the larger values). What
    never changes in a row (lineage, start) may come from any of its updates. Starts and ends are taken from the
    sequence number or else from the label, which is looked up in ``versions`` without regard to case and blanks. A
    row without any lineage is a lineage of its own (``lone`` holds its row id, ``lineage_id`` is null). An unknown
    start is a null ``seq``; an unknown end counts as no end.
    """
    s = snippets.select(
        "row_id", "repo", "lineage_id", "exported_at", clean_id(F.col("snippet_id")).alias("snippet_id"), "file_path", "qualname", "ordinal", "kind", "line_start", "line_end",
        "seq_added", "seq_removed", clean_label(F.col("version_added")).alias("label_added"), clean_label(F.col("version_removed")).alias("label_removed"),
    )
    state = F.struct(*[a for a in ATTRS if a != "repo"], "seq_removed", "label_removed")
    when = F.struct("exported_at", F.coalesce("seq_removed", F.when(F.col("label_removed").isNotNull(), 0), F.lit(-1)).alias("r"), *ATTRS)
    alone = F.when(F.col("row_id").isNull(), F.struct("repo", *PLACE))
    rows = (
        s.groupBy("row_id", alone.alias("alone"))
        .agg(
            F.max_by(state, when).alias("s"), F.max("exported_at").alias("exported_at"), F.max("lineage_id").alias("lineage_id"), F.max("repo").alias("repo"),
            F.max("seq_added").alias("seq_added"), F.max("label_added").alias("label_added"),
        )
        .select("row_id", "repo", "lineage_id", "exported_at", "seq_added", "label_added", "s.*")
    )
    pairs = versions.where("seq is not null").select("repo", clean_label(F.col("version")).alias("label"), "seq").where("label is not null")
    labels = pairs.groupBy("repo", "label").agg(F.max("seq").alias("seq")).groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("label", "seq"))).alias("labels"))
    rows = rows.join(labels, "repo", "left")
    known = lambda seq, label: F.coalesce(F.col(seq), F.col("labels")[F.col(label)])
    rows = rows.select(
        "lineage_id", F.when(F.col("lineage_id").isNull(), F.coalesce("row_id", F.xxhash64("repo", *PLACE))).alias("lone"), *ATTRS,
        F.struct("exported_at", "row_id").alias("prio"), known("seq_added", "label_added").alias("a"), known("seq_removed", "label_removed").alias("r"),
    )
    opened = F.struct(F.col("a").alias("seq"), F.lit(True).alias("live"))
    closed = F.struct(F.col("r").alias("seq"), F.lit(False).alias("live"))
    both = F.when(F.col("r").isNull(), F.array(opened)).otherwise(F.array(opened, closed))
    return rows.select(*KEY, *ATTRS, "prio", F.inline(both))


def lineage_store(snippets: DataFrame, versions: DataFrame, every: int = EVERY) -> DataFrame:
    """The checkpoint-and-patch store of all lineages."""
    events = snippet_events(snippets, versions).repartition(*KEY)
    return build_store(one_event_per_version(events, KEY, ATTRS), KEY, ATTRS, every)


def lineage_periods(snippets: DataFrame, versions: DataFrame, every: int = EVERY) -> DataFrame:
    """Every lineage's periods, with the place and the first line numbers of each."""
    return periods(lineage_store(snippets, versions, every), KEY, ATTRS, PLACE)
