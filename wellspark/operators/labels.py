"""The label project: an append-only decision log; the current state is a view over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = "log_id long, ts string, session_id long, op_id long, cell_id long, label_id long, state int"


def current_states(log: DataFrame) -> DataFrame:
    """cell_id, label_id, state of the newest entry; cleared decisions (null) are left out."""
    last = log.groupBy("cell_id", "label_id").agg(F.max_by(F.struct("state"), "log_id").alias("s"))
    return last.select("cell_id", "label_id", F.col("s.state").alias("state")).filter("state is not null")


def states_per_cell(cells: DataFrame, states: DataFrame) -> DataFrame:
    """Every cell with ``states``, a map of label to state (empty where nothing is decided)."""
    maps = states.groupBy("cell_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_id", "state")))).alias("states"))
    return cells.join(maps, "cell_id", "left").withColumn("states", F.coalesce("states", F.create_map().cast("map<long,int>")))


def label_counts(labels: DataFrame, states: DataFrame) -> DataFrame:
    """Every label with its positive and negative decisions."""
    n = states.groupBy("label_id").agg(F.count_if(F.col("state") == 1).alias("n_pos"), F.count_if(F.col("state") == 0).alias("n_neg"))
    return labels.join(n, "label_id", "left").fillna(0, ["n_pos", "n_neg"])


def project_stats(cells: DataFrame, states: DataFrame) -> DataFrame:
    """total, labelled and unlabelled cells."""
    total = cells.agg(F.count_distinct("cell_id").alias("total"))
    done = states.join(cells.select("cell_id").distinct(), "cell_id", "left_semi").agg(F.count_distinct("cell_id").alias("labelled"))
    return total.join(F.broadcast(done)).select("total", "labelled", (F.col("total") - F.col("labelled")).alias("unlabelled"))


def next_number(df: DataFrame, column: str) -> int:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("n")).first()["n"]


def _appended(log: DataFrame, rows: DataFrame, op_id: int, session_id: int, ts: Column | None = None) -> DataFrame:
    """``rows`` (cell_id, label_id, state) as new entries of one operation, numbered after the log's end."""
    start = next_number(log, "log_id") - 1
    numbered = rows.withColumn("log_id", F.row_number().over(Window.orderBy("cell_id", "label_id")) + F.lit(start).cast("long"))
    entries = numbered.select(
        F.col("log_id").cast("long"), (F.lit(None) if ts is None else ts).cast("string").alias("ts"), F.lit(session_id).cast("long").alias("session_id"),
        F.lit(op_id).cast("long").alias("op_id"), F.col("cell_id").cast("long"), F.col("label_id").cast("long"), F.col("state").cast("int"),
    )
    return log.unionByName(entries)


def apply_batch(log: DataFrame, cells: DataFrame, label_ids: list[int], state: int | None, session_id: int = 1, single: bool = False) -> DataFrame:
    """Set (or clear with null) labels on cells as one operation.

    With ``single`` a positive decision clears the cell's other positives in the same operation.
    """
    op = next_number(log, "op_id")
    wanted = cells.select("cell_id").distinct().withColumn("label_id", F.explode(F.array(*(F.lit(x).cast("long") for x in label_ids)))).withColumn("state", F.lit(state).cast("int"))
    if single and state == 1:
        others = current_states(log).filter((F.col("state") == 1) & ~F.col("label_id").isin(label_ids))
        cleared = others.join(wanted.select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "label_id", F.lit(None).cast("int").alias("state"))
        wanted = wanted.unionByName(cleared)
    return _appended(log, wanted, op, session_id)


def last_operation(log: DataFrame, undone: DataFrame, session_id: int) -> int | None:
    """The session's newest operation that isn't undone."""
    rows = log.filter(F.col("session_id") == session_id).join(undone, "op_id", "left_anti")
    return rows.agg(F.max("op_id").alias("op")).first()["op"]


def undo(log: DataFrame, undone: DataFrame, session_id: int) -> tuple[DataFrame, DataFrame]:
    """The log with an operation appended that restores what held before the last one, and the undone set.

    The undo itself belongs to no session's history (session 0), so undoing again walks further back.
    """
    op = last_operation(log, undone, session_id)
    if op is None:
        return log, undone
    touched = log.filter(F.col("op_id") == op)
    first = touched.agg(F.min("log_id")).first()[0]
    before = log.filter(F.col("log_id") < first).groupBy("cell_id", "label_id").agg(F.max_by(F.struct("state"), "log_id").alias("s"))
    restored = touched.select("cell_id", "label_id").distinct().join(before, ["cell_id", "label_id"], "left").select("cell_id", "label_id", F.col("s.state").alias("state"))
    spark = log.sparkSession
    return _appended(log, restored, next_number(log, "op_id"), 0), undone.unionByName(spark.createDataFrame([(op,)], "op_id long"))


def state_before(log: DataFrame, log_id: int) -> DataFrame:
    """The decisions that held just before an entry, cleared ones as null."""
    w = Window.partitionBy("cell_id", "label_id").orderBy(F.col("log_id").desc())
    return log.filter(F.col("log_id") < log_id).withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("cell_id", "label_id", "state")


def register_cells(cells: DataFrame, incoming: DataFrame) -> DataFrame:
    """New paths get the next ids in path order; known ones take the incoming preset."""
    start = next_number(cells, "cell_id") - 1
    fresh = incoming.dropDuplicates(["filepath"]).join(cells, "filepath", "left_anti")
    fresh = fresh.select((F.row_number().over(Window.orderBy("filepath")) + F.lit(start).cast("long")).cast("long").alias("cell_id"), "filepath", "preset")
    known = cells.join(incoming.dropDuplicates(["filepath"]).select("filepath", F.col("preset").alias("__new")), "filepath", "left")
    return known.select("cell_id", "filepath", F.coalesce("__new", "preset").alias("preset")).unionByName(fresh)


def add_label(labels: DataFrame, name: str, palette: list[str]) -> DataFrame:
    """One more label with the next id, order and palette colour; a known name changes nothing."""
    row = labels.agg(F.max("label_id"), F.max("sort_order"), F.count_if(F.col("name") == name)).first()
    if row[2]:
        return labels
    n = (row[0] or 0) + 1
    new = labels.sparkSession.createDataFrame([(n, name, palette[(n - 1) % len(palette)], (row[1] if row[1] is not None else -1) + 1)], "label_id long, name string, color string, sort_order int")
    return labels.unionByName(new)


def delete_label(labels: DataFrame, log: DataFrame, label_id: int) -> tuple[DataFrame, DataFrame]:
    """The registry without the label, and current decisions without it; the log stays as it is."""
    return labels.filter(F.col("label_id") != label_id), current_states(log).filter(F.col("label_id") != label_id)


def reorder_labels(labels: DataFrame, order: list[int]) -> DataFrame:
    place = F.array_position(F.array(*(F.lit(x).cast("long") for x in order)), F.col("label_id"))
    return labels.withColumn("sort_order", F.when(place > 0, (place - 1).cast("int")).otherwise(F.col("sort_order")))


def export_labels(cells: DataFrame, labels: DataFrame, states: DataFrame) -> DataFrame:
    """filepath and its positive labels' names joined by semicolons, in label order."""
    rows = states.filter("state = 1").join(cells, "cell_id").join(labels, "label_id")
    names = F.transform(F.array_sort(F.collect_list(F.struct("label_id", "name"))), lambda s: s["name"])
    return rows.groupBy("filepath").agg(F.concat_ws(";", names).alias("labels"))


def queue(cells: DataFrame, score: Column, ascending: bool, offset: int = 0, limit: int = 200) -> DataFrame:
    """One page (at most 500) by score, ties by cell."""
    order = F.col("__score").asc_nulls_last() if ascending else F.col("__score").desc_nulls_last()
    return cells.withColumn("__score", score).orderBy(order, "cell_id").drop("__score").offset(offset).limit(min(limit, 500))


def uncertainty(p: Column, middle: float = 0.5) -> Column:
    return F.abs(p - middle)


def cluster_cards(cells: DataFrame, states: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size and undecided cells of each cluster, largest first."""
    decided = states.select("cell_id").distinct().withColumn("__d", F.lit(1))
    return cells.join(decided, "cell_id", "left").groupBy(cluster).agg(F.count("*").alias("size"), F.count_if(F.col("__d").isNull()).alias("undecided")).orderBy(F.col("size").desc(), cluster)


def annotate_cluster(log: DataFrame, cells: DataFrame, cluster_id: object, label_id: int, state: int, undecided_only: bool = True, session_id: int = 1) -> DataFrame:
    """Decide a label for a cluster's cells that are in scope."""
    chosen = cells.filter(F.col("cluster") == cluster_id)
    if undecided_only:
        chosen = chosen.join(current_states(log).filter(F.col("label_id") == label_id), "cell_id", "left_anti")
    return apply_batch(log, chosen, [label_id], state, session_id)


def payload(cells: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Cells with their (score, label_id, source) suggestions, best first."""
    rows = suggestions.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "label_id", "source"))).alias("__s"))
    out = cells.join(rows, "cell_id", "left")
    return out.withColumn("suggestions", F.transform("__s", lambda s: F.struct((-s["minus"]).alias("score"), s["label_id"].alias("label_id"), s["source"].alias("source")))).drop("__s")
