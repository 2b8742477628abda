import threading
from datetime import datetime

import pyarrow as pa
import pytest

from pairfold.operators import distances
from pairfold.plans.study import Study, create_simulation
from pairfold.sources import commits, frames, store
from pairfold.streaming import log as stream

TINY = Study(num_subjects=(2,), trials_per_subject=(2,), images_per_trial=(4,), subjects_noise_scale=(0.0,), subjects_noise_df=(1,), reps=2)


def test_latest_name(spark):
    names = ["simulation_20250101.pkl", "simulation_20250201.pkl", "simulation_20250115_b.pkl", "notes.txt", "simulation_20260101.csv"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert store.latest(df, suffix=".pkl").first()[0] == "simulation_20250201.pkl"


def test_snapshots(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load_latest(spark, str(tmp_path))
    path = create_simulation(spark, str(tmp_path), 10, 3, TINY)
    assert path.endswith(store.snapshot_name(datetime.now()))
    df = store.load_latest(spark, str(tmp_path))
    assert df.count() > 0 and set(store.ex.PARAMS) < set(df.columns)
    assert store.get_experiment(df, num_subjects=2).count() == df.count() and store.get_experiment(df, num_subjects=9).count() == 0
    assert store.load_or_create(spark, str(tmp_path), lambda: 1 / 0).count() == df.count()


def test_top_up(spark, tmp_path):
    vectors, at = distances.make_embeddings(spark, 10, 3), str(tmp_path / "store")
    grid = TINY.grid(spark)
    one = store.get_or_run(spark, at, grid, vectors, reps=1)
    first = sorted(map(tuple, one.collect()))
    two = store.get_or_run(spark, at, grid, vectors, reps=2)
    assert {r["rep"] for r in two.collect()} == {0, 1}
    again = store.get_or_run(spark, at, grid, vectors, reps=1)
    assert sorted(map(tuple, again.collect())) == first


def test_one_more(spark, tmp_path):
    vectors, at = distances.make_embeddings(spark, 10, 3), str(tmp_path / "store")
    grid = TINY.grid(spark)
    for rep in range(3):
        assert {r["rep"] for r in store.run_experiment(spark, at, grid, vectors).collect()} == {rep}
    rows = store.read_store(spark, at)
    assert rows.where("run_at is null").count() == 0
    assert store.get_or_run(spark, at, grid, vectors, reps=3).count() == rows.count()
    with pytest.raises(ValueError):
        store.run_experiment(spark, at, grid, distances.make_embeddings(spark, 4, 3))


def test_one_spread_for_all_runs(spark, tmp_path, monkeypatch):
    """All pairs of vectors are compared once, though several repetitions are run one after the other."""
    from __spark_entry__ import queries

    found, own = [], distances.distance_spread
    monkeypatch.setattr(distances, "distance_spread", lambda *a, **b: found.append(1) or own(*a, **b))
    for name in ("one_more_repetition", "top_up"):
        found.clear()
        assert queries()[name](spark, "/root/testdata/sf0.001").columns and len(found) == 1
    vectors, at = distances.make_embeddings(spark, 12, 3), str(tmp_path / "s")
    spread = distances.known_spread(vectors)
    found.clear()
    rows = [sorted(map(tuple, store.run_experiment(spark, at, TINY.grid(spark), vectors, spread=spread).collect())) for _ in range(2)]
    assert not found and rows[0] != rows[1]


def test_rows_where(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert [r["x"] for r in store.rows_where(df, y=None).collect()] == [2] and store.rows_where(df, x=1, y="b").count() == 0


def test_log(spark, tmp_path):
    at = str(tmp_path / "log")
    assert store.load_outcomes(spark, at).count() == 0
    schema = "config int, rep int, ndim int, niter int, stress double, confdist array<float>, error string"
    store.append_outcomes(spark.createDataFrame([(0, 0, 2, 5, 0.5, [1.0], None), (0, 1, 2, None, None, None, "bad")], schema), at)
    store.append_outcomes(spark.createDataFrame([(0, 1, 2, 7, 0.25, [2.0], None)], schema), at)
    got = {r["rep"]: (r["niter"], r["error"]) for r in store.load_outcomes(spark, at).collect()}
    assert got == {0: (5, None), 1: (7, None)}
    assert stream.current(spark, str(tmp_path / "table")).count() == 0
    q = stream.follow(spark, at, str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    store.append_outcomes(spark.createDataFrame([(0, 0, 2, 9, 0.1, [3.0], None)], schema), at)
    q = stream.follow(spark, at, str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert {r["rep"]: r["niter"] for r in stream.current(spark, str(tmp_path / "table")).collect()} == {0: 9, 1: 7}
    store.append_outcomes(spark.createDataFrame([(0, 1, 2, 8, 0.1, [3.0], None)], schema), at)
    stream.follow(spark, at, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {r["rep"]: r["niter"] for r in stream.current(spark, str(tmp_path / "table")).collect()} == {0: 9, 1: 8}
    assert len(list((tmp_path / "table").glob("version=*"))) == 2


def test_one_number_for_each_of_many_writers(spark, tmp_path):
    at, got = f"file:{tmp_path}/numbers", []

    def write(who):
        for k in range(4):
            got.append(commits.commit(spark, at, lambda before: {"who": who, "k": k, "before": len(before)}))

    writers = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(got) == list(range(16))
    found = commits.entries(spark, at)
    assert [n for n, _ in found] == list(range(16)) and all(e["before"] == n for n, e in found)
    assert {(e["who"], e["k"]) for _, e in found} == {(w, k) for w in range(4) for k in range(4)}
    assert commits.commit(spark, at, lambda before: None) is None and len(commits.entries(spark, at)) == 16


def test_two_sweeps_of_one_store(spark, tmp_path, monkeypatch):
    """A writer that was overtaken leaves the experiments to the other one: none is lost, none is there twice."""
    vectors, at, grid = distances.make_embeddings(spark, 10, 3), str(tmp_path / "store"), TINY.grid(spark)
    commit, overtaken = commits.commit, []

    def late(*args):
        if not overtaken:
            overtaken.append(1)
            store.get_or_run(spark, at, grid, vectors, reps=1)
        return commit(*args)

    monkeypatch.setattr(commits, "commit", late)
    both = store.get_or_run(spark, at, grid, vectors, reps=2)
    alone = store.get_or_run(spark, str(tmp_path / "alone"), grid, vectors, reps=2)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, alone.collect()))
    assert [len(e["experiments"]) for _, e in commits.entries(spark, f"{at}/commits")] == [1, 1]
    overtaken.clear()

    def one_more(*args):
        if not overtaken:
            overtaken.append(1)
            store.run_experiment(spark, at, grid, vectors)
        return commit(*args)

    monkeypatch.setattr(commits, "commit", one_more)
    assert {r["rep"] for r in store.run_experiment(spark, at, grid, vectors).collect()} == {3}
    rows = store.read_store(spark, at)
    assert rows.groupBy(*store.ex.PARAMS, "rep", "i", "j").count().where("count > 1").isEmpty() and {r["rep"] for r in rows.select("rep").distinct().collect()} == {0, 1, 2, 3}


def test_uncommitted_files_are_not_read(spark, tmp_path):
    vectors, at = distances.make_embeddings(spark, 10, 3), str(tmp_path / "store")
    rows = sorted(map(tuple, store.get_or_run(spark, at, TINY.grid(spark), vectors, reps=1).collect()))
    store.read_store(spark, at).write.partitionBy(*store.ex.PARAMS).parquet(f"{at}/data/batch=bad")
    assert sorted(map(tuple, store.get_or_run(spark, at, TINY.grid(spark), vectors, reps=1).collect())) == rows
    assert store.read_store(spark, str(tmp_path / "none")).count() == 0


def test_two_writers_of_one_log(spark, tmp_path):
    at, schema = str(tmp_path / "log"), "config int, rep int, ndim int, niter int, stress double, confdist array<float>, error string"
    write = lambda w: store.append_outcomes(spark.createDataFrame([(w, k, 2, 1, 0.5, None, None) for k in range(50)], schema), at)
    writers = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    rows = spark.read.schema(store.LOG).parquet(at)
    assert rows.count() == rows.select("seq").distinct().count() == store.load_outcomes(spark, at).count() == 150


def test_torn_file_gives_its_prefix(spark, tmp_path):
    """Cut off or damaged anywhere, a file gives exactly the records before that."""
    sent = [b"one", b"", b"three" * 100, b"four"]
    whole = b"".join(map(frames.frame, sent))
    ends = [len(b"".join(map(frames.frame, sent[:k]))) for k in range(5)]
    for n in range(len(whole) + 1):
        assert list(frames.records(pa.BufferReader(whole[:n]))) == sent[: sum(e <= n for e in ends) - 1]
    for at in range(0, len(whole), 7):
        bad = whole[:at] + bytes([whole[at] ^ 0x10]) + whole[at + 1 :]
        assert list(frames.records(pa.BufferReader(bad))) == sent[: sum(e <= at for e in ends) - 1]
    folder = tmp_path / "frames"
    assert frames.read_frames(spark, str(folder)).count() == 0
    folder.mkdir()
    (folder / "a.frames").write_bytes(whole)
    (folder / "b.frames").write_bytes(whole[: ends[2] + 3])
    (folder / "c.frames").write_bytes(b"\xff" * 50)
    (folder / "d.frames").write_bytes(b"")
    (folder / ".own.frames").write_bytes(whole)
    rows = frames.read_frames(spark, str(folder), 2).collect()
    assert sorted((r["file"], r["place"], bytes(r["payload"])) for r in rows) == sorted([("a.frames", k, p) for k, p in enumerate(sent)] + [("b.frames", k, p) for k, p in enumerate(sent[:2])])


def test_records_of_outcomes(spark, tmp_path):
    at = str(tmp_path / "solved")
    assert store.framed_outcomes(spark, at).count() == 0
    frames.write_record(at, "0-1-2", store.record_of(0, 1, 2, 7, 0.25, [1.5, 2.0], None))
    frames.write_record(at, "0-1-3", store.record_of(0, 1, 3, None, None, None, "bad: é"))
    frames.write_record(at, "0-1-3", store.record_of(0, 1, 3, None, None, None, "bad: é"))
    (tmp_path / "solved" / "0-1-4.frames").write_bytes(frames.frame(store.record_of(0, 1, 4, 1, 0.5, [], None))[:-1])
    got = {r["ndim"]: tuple(r) for r in store.framed_outcomes(spark, at).collect()}
    assert got == {2: (0, 1, 2, 7, 0.25, [1.5, 2.0], None), 3: (0, 1, 3, None, None, None, "bad: é")}
    frames.delete(at, ["0-1-2", "none"])
    assert [r["ndim"] for r in store.framed_outcomes(spark, at).collect()] == [3]


def test_claims(tmp_path):
    at = str(tmp_path / "claims")
    assert frames.claim(at, "t", "me", 60) and frames.claim(at, "t", "me", 60) and not frames.claim(at, "t", "you", 60)
    assert frames.claim(at, "t", "you", 0) and not frames.claim(at, "t", "me", 60) and frames.claim(at, "u", "me", 60)
    assert sorted(p.name for p in (tmp_path / "claims").iterdir()) == ["t", "u"]
