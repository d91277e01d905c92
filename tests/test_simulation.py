import math

import pytest
from pyspark.sql import functions as F

from tarnflow.functions.physics import THROATS, WATER
from tarnflow.plans import runs
from tarnflow.streaming import simulation


def test_a_vented_tank_follows_torricelli(spark):
    rows = sorted(runs.torricelli_run(spark, "").collect())
    for k in (2, 3, 4):
        own = [r for r in rows if r.scenario_id == k]
        plan, hole = 38 * 0.01, k * 0.01
        cap = 2 * WATER.sigma / (WATER.rho * WATER.g * hole)
        start = math.sqrt(0.24 + 0.005 - cap)
        for r in own:
            s = max(start - THROATS.discharge * hole / plan * math.sqrt(WATER.g / 2) * r.t, 0.0)
            level = r.inside / plan
            assert abs(level - (s * s + cap - 0.005)) < 0.012, (k, r.t, level)
            assert abs(r.inside + r.drained + r.lost + (r.held - r.inside) - 0.24 * plan) < 1e-9
        assert own[-1].inside < own[0].inside


def test_a_plug_holds_until_it_opens(spark):
    rows = sorted(runs.plugged_hole_run(spark, "").collect())
    before = [r.inside for r in rows if r.t < 1.05]
    assert all(abs(v - before[0]) < 1e-12 for v in before) and rows[-1].inside < 0.95 * before[0]


def test_resuming_changes_nothing(spark):
    stopped = sorted(runs.checkpoint_resume_run(spark, "").collect())
    whole = sorted(simulation.run(runs.scenarios(spark, [(2, "tank", {"fill": 0.8, "hole": 3.0, "open_at": 0.0}, 20, 0.1, 0.0)])).collect())
    assert [r.step for r in stopped] == list(range(1, 21))
    assert all(a.inside == pytest.approx(b.inside, abs=1e-12) for a, b in zip(stopped, whole, strict=True))


def test_a_stream_of_ticks_gives_the_same_steps(spark, tmp_path):
    one = runs.scenarios(spark, [(5, "tank", {"fill": 0.5, "hole": 2.0, "open_at": 0.0}, 4, 0.1, 0.0)])
    ticks = one.select("scenario_id", "scene", "parameters", "turn")
    for k in range(4):
        ticks.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
    q = simulation.stream_steps(stream, 0.1).writeStream.format("memory").queryName("steps").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(spark.table("steps").collect())
    whole = sorted(simulation.run(one).collect())
    assert [(r.step, round(r.inside, 12)) for r in got] == [(r.step, round(r.inside, 12)) for r in whole]
    assert spark.table("steps").filter(F.col("scenario_id") != 5).count() == 0
