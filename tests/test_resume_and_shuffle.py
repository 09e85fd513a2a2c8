import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import shuffle
from siltstone.plans.resume import MARKER, Run, Stage


def runner(spark, tmp_path, calls, settings=2, version=1, fail=()):
    events = []

    def step(name, f):
        def make(inputs, given):
            calls.append(name)
            if name in fail:
                raise RuntimeError("killed")
            return f(inputs, given)

        return make

    stages = [
        Stage("clean", step("clean", lambda i, g: i["docs"].filter("id > 0")), ("docs",)),
        Stage("scaled", step("scaled", lambda i, g: i["clean"].select((F.col("id") * g["by"]).alias("id"))), ("clean",), {"by": settings}, version),
        Stage("other", step("other", lambda i, g: i["clean"].agg(F.count("*").alias("n"))), ("clean",)),
        Stage("both", step("both", lambda i, g: i["scaled"].crossJoin(i["other"])), ("scaled", "other")),
    ]
    run = Run(spark, str(tmp_path / "store"), {"docs": str(tmp_path / "docs")}, lambda e: events.append((e["event"], e.get("stage"))))
    return run, stages, events


def test_a_run_goes_on_after_the_last_finished_stage(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "docs"))
    calls = []
    run, stages, events = runner(spark, tmp_path, calls, fail=("other",))
    with pytest.raises(RuntimeError):
        run.all(stages)
    assert calls == ["clean", "scaled", "other"] and events[-1] == ("error", "other")
    calls.clear()
    run, stages, events = runner(spark, tmp_path, calls)
    got = run.all(stages)["both"]
    assert calls == ["other", "both"] and sorted(map(tuple, got.collect())) == [(2, 4), (4, 4), (6, 4), (8, 4)]
    assert [e for e in events if e[0] == "kept"] == [("kept", "clean"), ("kept", "scaled")] and events[-1][0] == "finished"
    calls.clear()
    run, stages, _ = runner(spark, tmp_path, calls, settings=3)
    assert sorted(r.id for r in run.all(stages)["both"].collect()) == [3, 6, 9, 12] and calls == ["scaled", "both"]
    calls.clear()
    run, stages, _ = runner(spark, tmp_path, calls, version=2)
    assert run.all(stages) and calls == ["scaled", "both"]
    calls.clear()
    run, stages, _ = runner(spark, tmp_path, calls)
    (tmp_path / "store" / f"other-{run_print(run, stages)}" / MARKER).unlink()  # as if it had been killed before its commit
    assert run.all(stages) and calls == ["other"]
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    calls.clear()
    run, stages, _ = runner(spark, tmp_path, calls)
    assert run.all(stages)["other"].first().n == 8 and calls == ["clean", "scaled", "other", "both"]
    with pytest.raises(KeyError, match="nothing"):
        run.stage(Stage("x", lambda i, g: i["nothing"], ("nothing",)))


def run_print(run, stages):
    run.stage(stages[0])
    return run.fingerprint(stages[2])[:16]


@pytest.mark.parametrize("n, buffer", [(0, 10), (7, 10), (10, 10), (1000, 1), (5000, 64), (3000, 10_000)])
def test_a_buffer_mixes_whole_rows_within_bounds(spark, n, buffer):
    rows = spark.range(0, n, 1, 1).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"))
    got = [(r.id, r.text, r.x) for r in shuffle.buffered(rows, buffer, 5).collect()]
    assert sorted(got) == sorted((i, f"t{i}", i if i % 3 else None) for i in range(n)) if n and n % 3 else len(got) == n
    assert all(at >= i - buffer for at, (i, *_) in enumerate(got))
    if buffer > 1 and n > 10:
        assert [r[0] for r in got] != list(range(n)) and got == [(r.id, r.text, r.x) for r in shuffle.buffered(rows, buffer, 5).collect()]
        assert got != [(r.id, r.text, r.x) for r in shuffle.buffered(rows, buffer, 6).collect()]
    if buffer == 1:
        assert [r[0] for r in got] == list(range(n))


def test_draws_are_those_of_a_buffer_row_by_row():
    rng, again = np.random.default_rng(3), np.random.default_rng(3)
    out, stay = shuffle.drawn(8, 50, rng)
    slots, want = list(range(8)), []
    for k, slot in enumerate(again.integers(0, 8, 50).tolist()):
        want.append(slots[slot])
        slots[slot] = 8 + k
    assert out.tolist() == want and stay.tolist() == slots
    with pytest.raises(ValueError):
        shuffle.buffered(None, 0)
