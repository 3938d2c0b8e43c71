"""The query log and the runs of a two-stage analysis as streams: what comes again is written once, and each run's state follows its events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The stages of a run, in order.
STAGES = ("profiler", "note_generator")


def drained(stream: DataFrame, checkpoint: str, sink: str, mode: str = "append") -> list[dict]:
    """Runs a stream over all that is there and not done yet, each batch into its own folder of sink (a batch that runs again overwrites it). Returns the batches' progress."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)


def late_rows(progress: list[dict]) -> int:
    """Rows that came later than the watermark allows, over all batches."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def once(requests: DataFrame, key: str = "idempotency_key", at: str = "at", delay: str = "1 day") -> DataFrame:
    """The first row of each key that comes; one that comes again within `delay` of event time, in the same batch or a later one, is dropped. State is kept for that long and no longer.
    Rows without a key are left out. Works on a stream; a row that is later than the watermark (which begins at 1970) is dropped too, and late_rows() counts it."""
    return requests.where(F.col(key).isNotNull()).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


#: What is known of a run, and what is told of it.
STATE = "advances int, output string, n_manifests int, n_quarantined int, n_events long"
RESULT = "run_id long, stage string, status string, n_manifests int, n_quarantined int, n_events long"


def rules():
    """(after, told): the state of a run after one event, and a row of RESULT.

    An output (valid, invalid by its schema, or partial: no whole JSON) waits for a resume. A resume takes a valid one and goes to the next stage, puts an invalid one aside, and
    unless the run is done then asks for the stage by a manifest. Nothing changes a run that is done.
    """
    stages = STAGES

    def after(state: tuple, kind: str) -> tuple:
        advances, output, manifests, quarantined, events = state
        if advances < len(stages) and kind == "resume":
            advances, quarantined = advances + (output == "valid"), quarantined + (output == "invalid")
            output, manifests = None, manifests + (advances < len(stages))
        elif advances < len(stages) and kind in ("valid", "invalid", "partial"):
            output = kind
        return advances, output, manifests, quarantined, events + 1

    def told(run_id: int, state: tuple) -> tuple:
        advances, output, manifests, quarantined, events = state
        if advances == len(stages):
            return run_id, "done", "done", manifests, quarantined, events
        return run_id, stages[advances], "filled" if output in ("valid", "invalid") else "pending", manifests, quarantined, events

    return after, told


def run_states(events: DataFrame) -> DataFrame:
    """RESULT of each run whose events (run_id, at, event_id, kind) came in a batch, by state that Spark keeps for each run; a batch's events are put in the order of at, event_id.

    kind: resume, valid, invalid or partial; others count as events only. Rows without a run are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    (step, shown), names = rules(), [c.split()[0] for c in RESULT.split(", ")]
    form = STATE

    class Run(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("run", form)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            now = tuple(self.state.get()) if self.state.exists() else (0, None, 0, 0, 0)
            for kind in pd.concat(list(rows)).sort_values(["at", "event_id"]).kind:
                now = step(now, kind)
            self.state.update(now)
            yield pd.DataFrame([shown(key[0], now)], columns=names)

        def close(self) -> None:
            pass

    return events.where("run_id is not null").groupBy("run_id").transformWithStateInPandas(statefulProcessor=Run(), outputStructType=RESULT, outputMode="Update", timeMode="None")


def newest(sink: DataFrame) -> DataFrame:
    """The latest row of each run among those that batches wrote."""
    row = F.struct(*[c.split()[0] for c in RESULT.split(", ")])
    return sink.groupBy("run_id").agg(F.max_by(row, "n_events").alias("r")).select("r.*")


def run_states_of(events: DataFrame) -> DataFrame:
    """RESULT of each run from a whole table of events: the same as run_states() over batches of it, by windows.

    What a resume meets is the last output since the resume before it.
    """
    order = Window.partitionBy("run_id").orderBy("at", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where("run_id is not null").withColumn("resumes", F.coalesce(F.count_if(F.col("kind") == "resume").over(so_far), F.lit(0)))
    output = F.when(F.col("kind").isin("valid", "invalid", "partial"), F.struct("at", "event_id", "kind"))
    turns = rows.groupBy("run_id", "resumes").agg(F.max(output).getField("kind").alias("output"), F.bool_or(F.coalesce(F.col("kind") == "resume", F.lit(False))).alias("resumed"), F.count("*").alias("n"))
    taken = F.col("resumed") & (F.coalesce("output", F.lit("")) == "valid")
    placed = turns.withColumn("advances", F.count_if(taken).over(Window.partitionBy("run_id").orderBy("resumes").rowsBetween(Window.unboundedPreceding, 0)))
    last = len(STAGES)
    before = F.col("advances") - taken.cast("int")
    sums = placed.groupBy("run_id").agg(
        F.least(F.lit(last), F.max("advances")).cast("int").alias("a"),
        F.max_by(F.when(~F.col("resumed"), F.col("output")), "resumes").alias("output"),
        F.count_if(F.col("resumed") & (F.col("advances") < last)).cast("int").alias("n_manifests"),
        F.count_if(F.col("resumed") & (F.coalesce("output", F.lit("")) == "invalid") & (before < last)).cast("int").alias("n_quarantined"),
        F.sum("n").alias("n_events"),
    )
    status = F.when(F.col("a") == last, "done").when(F.col("output").isin("valid", "invalid"), "filled").otherwise("pending")
    return sums.select("run_id", F.element_at(F.array(*map(F.lit, (*STAGES, "done"))), F.col("a") + 1).alias("stage"), status.alias("status"), "n_manifests", "n_quarantined", "n_events")


def in_batches(rows: DataFrame, folder: str, at: str, batches: int = 4) -> Callable[[SparkSession], DataFrame]:
    """Writes rows as files in the order of `at` and gives a stream over them that takes about a batch of them at a time."""
    cuts = rows.agg(F.percentile_approx(at, [k / batches for k in range(1, batches)], 10_000).alias("_cuts"))
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("_place", F.coalesce(F.size(F.filter("_cuts", lambda c: F.col(at) > c)), F.lit(0))).drop("_cuts")
    for k in range(batches):
        placed.where(F.col("_place") == k).drop("_place").repartition(4).write.parquet(f"{folder}/part={k}")
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return lambda session: session.readStream.schema(names).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", True).parquet(folder)
