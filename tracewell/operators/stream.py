"""What a reader of an event stream need not see: passes that mark or fold rows. Each adds columns; none drops rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import exprs as X

#: Milliseconds and pixels of the passes, fixed values.
SELECTION_MS, INPUT_MS, CAUSE_MS, PRESS_MS, PRESS_ROWS, PRESS_DRIFT = 1000, 50, 50, 1000, 5, 15
SILENT = ("Mutation", "MouseMove", "StyleSheetRule", "CanvasMutation", "Font", "Log")


def _stream(*keys: str):
    return Window.partitionBy(*(keys or ("visitor_id",))).orderBy("timestamp", "counter")


def settled_selections(events: DataFrame) -> DataFrame:
    """dropped: a Selection that another follows within a second."""
    w = Window.partitionBy("visitor_id", "type_str").orderBy("timestamp", "counter")
    soon = (F.col("type_str") == "Selection") & (F.lead("timestamp").over(w) - F.col("timestamp") <= SELECTION_MS)
    return events.withColumn("dropped", F.coalesce(soon, F.lit(False)))


def settled_inputs(events: DataFrame) -> DataFrame:
    """dropped: an Input that another to the same node follows at once."""
    w = Window.partitionBy("visitor_id", "type_str", "node_id").orderBy("timestamp", "counter")
    soon = (F.col("type_str") == "Input") & (F.lead("timestamp").over(w) - F.col("timestamp") <= INPUT_MS)
    return events.withColumn("dropped", F.coalesce(soon, F.lit(False)))


def folded_presses(events: DataFrame) -> DataFrame:
    """folded: a press that a Click on the same target answers, among the next rows, soon and nearby."""
    row = F.struct("type_str", "timestamp", "target", "x", "y")
    after = F.collect_list(row).over(_stream().rowsBetween(1, PRESS_ROWS))
    marked = events.withColumn("after", after)
    near = lambda e: (
        (e["type_str"] == "Click")
        & (e["timestamp"] - F.col("timestamp") <= PRESS_MS)
        & e["target"].eqNullSafe(F.col("target"))
        & (F.abs(e["x"] - F.col("x")) <= PRESS_DRIFT)
        & (F.abs(e["y"] - F.col("y")) <= PRESS_DRIFT)
    )
    press = F.col("type_str").isin("MouseDown", "MouseUp", "TouchStart", "TouchEnd")
    return marked.withColumn("folded", press & F.exists("after", near)).drop("after")


def caused_focus(events: DataFrame) -> DataFrame:
    """folded: Focus and Blur next to a pointer event in time."""
    w = Window.partitionBy("visitor_id").orderBy("timestamp").rangeBetween(-CAUSE_MS, CAUSE_MS)
    pointer = F.max(F.col("type_str").isin("MouseDown", "MouseUp", "Click", "TouchStart", "TouchEnd").cast("int")).over(w)
    return events.withColumn("folded", F.col("type_str").isin("Focus", "Blur") & (pointer == 1))


def churn_runs(events: DataFrame, silent: tuple[str, ...] = SILENT) -> DataFrame:
    """Islands of rows that print nothing: first, last and number of each."""
    quiet = F.col("type_str").isin(*silent)
    marked = events.withColumn("quiet", quiet).withColumn("island", F.sum((~quiet).cast("int")).over(_stream().rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("quiet").groupBy("visitor_id", "island").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("rows"))
    return runs.drop("island")


def typing_runs(events: DataFrame) -> DataFrame:
    """Inputs with the value before them in the same document and field, whether they end the run, and what was added at the end."""
    epoch = F.sum(F.col("type_str").isin("FullSnapshot", "Meta", "PageLoad").cast("int")).over(_stream().rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy("visitor_id", "node_id", "epoch").orderBy("timestamp", "counter")
    inputs = events.withColumn("epoch", epoch).where(F.col("type_str") == "Input")
    inputs = inputs.withColumn("before", F.lag("input").over(w)).withColumn("ends", F.lead("input").over(w).isNull())
    grown = F.col("input").startswith(F.col("before"))
    return inputs.withColumn("added", F.when(grown, F.expr("substring(input, char_length(before) + 1)")))


def typed_changes(events: DataFrame) -> DataFrame:
    """typing_runs with what each step changed: where, what went, what came; of the first input of a run nothing but its value. That and the last of a run are ``whole``."""
    runs = typing_runs(events).withColumn("change", F.when(F.col("before").isNotNull(), X.edit_delta("before", "input")))
    whole = F.when(F.col("ends") | F.col("before").isNull(), F.col("input"))
    return runs.withColumns({"pos": F.col("change.at"), "old": F.col("change.old"), "new": F.col("change.new"), "whole": whole}).drop("change")


def repeated_targets(events: DataFrame, kinds: tuple[str, ...] = ("Scroll", "TouchStart", "Input")) -> DataFrame:
    """quiet_target: the row before, of the same kind, names the same element, so its text needn't be said again."""
    w = Window.partitionBy("visitor_id", "type_str").orderBy("timestamp", "counter")
    return events.withColumn("quiet_target", F.coalesce(F.col("type_str").isin(*kinds) & F.col("target").eqNullSafe(F.lag("target").over(w)) & F.lag("counter").over(w).isNotNull(), F.lit(False)))


def flip_chains(edits: DataFrame, least: int = 3) -> DataFrame:
    """Runs of one-line edits that each start where the last ended: collapsed if ``least`` or more follow each other."""
    w = _stream("visitor_id", "place")
    goes_on = F.col("old").eqNullSafe(F.lag("new").over(w)) & F.lag("counter").over(w).isNotNull()
    marked = edits.withColumn("chain", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("visitor_id", "place", "chain").agg(
        F.min_by("old", F.struct("timestamp", "counter")).alias("old"), F.max_by("new", F.struct("timestamp", "counter")).alias("new"), F.count("*").alias("edits"), (F.count("*") >= least).alias("collapsed")
    ).drop("chain")


def arrivals(events: DataFrame) -> DataFrame:
    """Pages that visitors came to: the first address, each other one, and each page load."""
    w = _stream()
    came = (F.col("type_str") == "PageLoad") | F.lag("url").over(w).isNull() | (F.col("url") != F.lag("url").over(w))
    return events.where("url is not null").withColumn("came", came).where("came").groupBy("url").agg(F.count("*").alias("arrivals"))


def kinds_by_count(events: DataFrame) -> DataFrame:
    """Kinds with their numbers; equally common ones in the order of their first appearance."""
    return events.groupBy("type_str").agg(F.count("*").alias("events"), F.min(F.struct("timestamp", "counter")).alias("seen")).orderBy(F.desc("events"), "seen").select("type_str", "events", F.col("seen.timestamp").alias("first_ts"))
