"""Streams against the same work on whole tables."""

from datetime import datetime, timedelta

from folioforge.streaming import logs

T = datetime(2024, 1, 1)


def files(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={k}")
    return lambda s: s.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_a_key_that_comes_again_is_written_once_and_late_rows_are_counted(spark, tmp_path):
    hour = timedelta(hours=1)
    batches = [[("a", T, 1), ("b", T, 2), (None, T, 3)], [("a", T + hour, 4), ("c", T + 5 * hour, 5)], [("b", T + 2 * hour, 6), ("d", T - 9 * hour, 7)], [("c", T + 6 * hour, 8), ("e", T + 6 * hour, 9)]]
    stream = files(spark, f"{tmp_path}/in", batches, "idempotency_key string, at timestamp, n int")(spark)
    progress = logs.drained(logs.once(stream, delay="4 hours"), f"{tmp_path}/ledger", f"{tmp_path}/out")
    rows = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("idempotency_key", "n").collect()))
    assert rows == [("a", 1), ("b", 2), ("c", 5), ("e", 9)]
    assert len([p for p in progress if p["numInputRows"]]) == 4 and logs.late_rows(progress) == 1
    # nothing is left to do, and nothing is written again
    assert not any(p["numInputRows"] for p in logs.drained(logs.once(stream, delay="4 hours"), f"{tmp_path}/ledger", f"{tmp_path}/out"))


def test_rules_of_a_run():
    after, told = logs.rules()
    state = (0, None, 0, 0, 0)
    seen = []
    for kind in ["resume", "partial", "resume", "invalid", "resume", "valid", None, "resume", "valid"]:
        state = after(state, kind)
        seen.append(told(7, state)[1:5])
    assert seen == [("profiler", "pending", 1, 0), ("profiler", "pending", 1, 0), ("profiler", "pending", 2, 0), ("profiler", "filled", 2, 0), ("profiler", "pending", 3, 1), ("profiler", "filled", 3, 1),
                    ("profiler", "filled", 3, 1), ("note_generator", "pending", 4, 1), ("note_generator", "filled", 4, 1)]
    assert told(7, after(state, "resume")) == (7, "done", "done", 4, 1, 10) and after(after(state, "resume"), "invalid")[:4] == (2, None, 4, 1)


def test_windows_agree_with_the_rules(spark):
    import numpy as np

    rng, kinds = np.random.default_rng(4), ["resume", "valid", "invalid", "partial", None]
    rows = [(int(rng.integers(0, 60)), T + timedelta(seconds=int(rng.integers(0, 300))), i, kinds[rng.integers(0, 5)]) for i in range(600)] + [(None, T, 1, "resume")]
    after, told = logs.rules()
    states = {}
    for run, _, _, kind in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        states[run] = after(states.get(run, (0, None, 0, 0, 0)), kind)
    got = logs.run_states_of(spark.createDataFrame(rows, "run_id long, at timestamp, event_id long, kind string"))
    assert sorted(map(tuple, got.collect())) == sorted(told(k, s) for k, s in states.items())
