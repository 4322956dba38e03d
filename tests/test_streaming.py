import datetime as dt

from loomwell.operators import jobs as J
from loomwell.streaming import jobs as S

T0 = dt.datetime(2024, 1, 1)


def batches(spark, rows, schema, folder, build, mode="append", log=None):
    """The stream's output after each batch of rows, each batch a run of its own over one checkpoint."""
    out = []
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/in", mode="append")
        got = []
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.outputMode(mode)
        query = stream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        if log is not None:
            log.append(query.lastProgress["stateOperators"][0])
        out.append(sorted(tuple(r) for r in got))
    return out


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


EVENTS = "job_id long, status string, ts timestamp"


def test_terminal_states_stay_and_their_state_ends(spark, tmp_path):
    rows = [
        [(1, "running", at(0)), (1, "done", at(5)), (1, "running", at(9)), (2, "na fila", at(0)), (None, "done", at(0)), (3, "done", None)],
        [(1, "running", at(60)), (2, "Running ", at(70))],
        [(2, "running", at(9000))],  # more than keep and delay after job 1 ended
        [(1, "erro", at(30)), (2, "running", at(9001))],  # late, dropped
        [(1, "running", at(9100))],  # the same id again: a new job
    ]
    log = []
    got = batches(spark, rows, EVENTS, str(tmp_path), S.job_state, "update", log)
    assert got[0] == [(1, "COMPLETED", 3), (2, "PENDING", 1)]
    assert got[1] == [(1, "COMPLETED", 4), (2, "RUNNING", 2)]
    assert (1, "COMPLETED", 4) not in got[2] and got[3] == [(2, "RUNNING", 4)]
    assert got[4] == [(1, "RUNNING", 1)]
    assert log[1]["numRowsTotal"] == 2 and log[3]["numRowsTotal"] == 1


def test_lines_across_batches_equal_the_batch_twin(spark, tmp_path):
    rows = [[(1, 1, "a"), (1, 2, "a"), (2, 1, "x")], [(1, 3, "a"), (1, 4, " "), (1, 5, "b"), (2, 2, "y"), (2, 3, None)]]
    schema = "job_id long, seq long, line string"
    got = batches(spark, rows, schema, str(tmp_path), S.progress_dedup)
    want = J.consecutive_dedup(spark.createDataFrame(rows[0] + rows[1], schema)).collect()
    assert {x for b in got for x in b} == {tuple(r) for r in want}


def test_lines_with_times_end_their_state(spark, tmp_path):
    rows = [[(1, 1, "a", at(0)), (2, 1, "x", at(0))], [(2, 2, "y", at(200_000))], [(2, 3, "y", at(200_001)), (1, 2, "b", at(10))], [(1, 3, "a", at(200_100)), (1, 4, "a", at(200_101))]]
    log = []
    got = batches(spark, rows, "job_id long, seq long, line string, ts timestamp", str(tmp_path), S.progress_dedup, log=log)
    assert got == [[(1, 1, "a"), (2, 1, "x")], [(2, 2, "y")], [], [(1, 3, "a")]]  # late: (1, 2); after the state's end: (1, 3)
    assert log[2]["numRowsTotal"] == 1


def test_stale_pending_jobs_are_told_once(spark, tmp_path):
    rows = [
        [(1, "pending", at(0)), (2, "pending", at(0)), (3, "na fila", at(0)), (4, "running", at(0))],
        [(2, "running", at(100)), (3, "pending", at(200))],
        [(4, "running", at(2000))],  # the watermark passes 300 s
        [(1, "pending", at(1500)), (4, "done", at(2100))],
        [(1, "running", at(2200)), (4, "done", at(4000))],
        [(3, "pending", at(10)), (4, "done", at(4001))],  # late
    ]
    log = []
    got = batches(spark, rows, EVENTS, str(tmp_path), S.stale_pending, log=log)
    ms = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    told = [x for b in got for x in b]
    assert sorted(told) == [(1, ms), (1, ms + 1_500_000), (3, ms)]
    assert not got[0] and not got[1] and log[-1]["numRowsTotal"] == 0


TEXT = "# T\n" + " ".join(f"Sentence {i} is here." for i in range(40))


def test_chunks_are_ingested_once(spark, tmp_path):
    for i in range(2):  # the same article arrives twice
        spark.createDataFrame([("a.md", TEXT)], "source string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source string, text string").parquet(str(tmp_path / "in"))
        S.ingest_chunks(stream, str(tmp_path / "index"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    ids = [r.chunk_id for r in spark.read.parquet(str(tmp_path / "index")).collect()]
    assert len(ids) == len(set(ids)) >= 1


def test_a_replayed_batch_writes_nothing(spark, tmp_path):
    index = str(tmp_path / "index")
    files = lambda: sorted(str(p) for p in (tmp_path / "index").rglob("*.parquet"))
    batch = lambda *names: spark.createDataFrame([(n, TEXT.replace("Sentence", n)) for n in names], "source string, text string")
    assert S.ingest_batch(batch("a", "b", "c"), 0, index)
    before = files()
    assert not S.ingest_batch(batch("a", "b", "c"), 0, index) and files() == before
    # a run that stopped before its log entry: what is there isn't added again
    (tmp_path / "index" / "_log" / "batch=0").unlink()
    (tmp_path / "index" / "_log" / ".batch=0.crc").unlink(missing_ok=True)
    count = spark.read.parquet(index).count()
    assert S.ingest_batch(batch("a", "b", "c"), 0, index) and spark.read.parquet(index).count() == count
    assert S.ingest_batch(batch("d"), 1, index) and spark.read.parquet(index).count() > count
    ids = [r.chunk_id for r in spark.read.parquet(index).collect()]
    assert len(ids) == len(set(ids))


def test_a_batch_reads_the_folders_of_its_articles_only(spark, tmp_path):
    index = str(tmp_path / "index")
    S.ingest_batch(spark.createDataFrame([(f"s{i}", TEXT) for i in range(60)], "source string, text string"), 0, index)
    folders = [p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("bucket=")]
    assert len(folders) > 30
    one = S.known_chunks(spark, index, [int(folders[0].split("=")[1])])
    assert len(one.inputFiles()) == 1 and S.known_chunks(spark, index, []) is None
    assert S.ingest_batch(spark.createDataFrame([], "source string, text string"), 1, index)


def test_windows_drop_late_events(spark, tmp_path):
    rows = [[("a", "done", at(0)), ("a", "done", at(60)), ("b", "erro", at(3500))], [("a", "done", at(8000))], [("a", "done", at(100)), ("a", "running", at(7900))], [("a", "done", at(20_000))], [("a", "done", at(20_001))]]
    got = batches(spark, rows, "stage string, status string, ts timestamp", str(tmp_path), S.windowed_counts)
    told = {(str(w), s, t, n) for b in got for w, s, t, n in b}
    assert told == {("2024-01-01 00:00:00", "a", "COMPLETED", 2), ("2024-01-01 00:00:00", "b", "FAILED", 1), ("2024-01-01 02:00:00", "a", "COMPLETED", 1), ("2024-01-01 02:00:00", "a", "RUNNING", 1)}
