"""Step loops of small scenes: volumes that must not change, levels that must fall, runs that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.plans.registry import query, r, table
from tarnflow.streaming import simulation


def scenarios(spark: SparkSession, rows: list[tuple[int, str, dict[str, float], int, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "scenario_id long, scene string, parameters map<string,double>, steps int, dt double, turn double")


@query("SELECT p_partkey AS scenario_id, s.range::INT + 1 AS step, round((p_size % 10 + 3) * 14 / 10000.0, 9) AS inside FROM part, range(6) s")
def closed_box_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shut boxes, filled to a level that a part's size gives, turned by 25 degrees a step: the volume stays."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("scenario_id"), F.lit("closed_box").alias("scene"), F.create_map(F.lit("fill"), (F.col("p_size") % 10 + 3) / 14.0).alias("parameters"), F.lit(6).alias("steps"), F.lit(0.5).alias("dt"), F.lit(50.0).alias("turn"))
    return simulation.run(rows).select("scenario_id", "step", r(F.col("inside"), 9).alias("inside"))


def torricelli_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vented tank drains through holes of three widths; tests hold the level against Torricelli's."""
    return simulation.run(scenarios(spark, [(k, "tank", {"fill": 0.8, "hole": float(k), "open_at": 0.0}, 30, 0.1, 0.0) for k in (2, 3, 4)]))


def plugged_hole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged hole opens after a second; nothing leaves before."""
    return simulation.run(scenarios(spark, [(1, "tank", {"fill": 0.8, "hole": 3.0, "open_at": 1.0}, 25, 0.1, 0.0)]))


def checkpoint_resume_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stops after ten steps and goes on from its saved state; tests hold it against one that doesn't stop."""
    first = scenarios(spark, [(2, "tank", {"fill": 0.8, "hole": 3.0, "open_at": 0.0}, 10, 0.1, 0.0)])
    a = simulation.run(first, state=True)
    b = simulation.run(simulation.resume_from(a, first, 10), state=True)
    return a.drop("state").union(b.drop("state"))
