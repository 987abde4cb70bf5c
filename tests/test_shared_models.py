"""Models and fields that stations share are worked on once."""

from strataspark.operators import tomography
from strataspark.plans.catalog import QUERIES


def _copies(spark, sf_dir, path):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("*", "explode(sequence(0, 2)) as k")
    s.withColumn("s_suppkey", s["s_suppkey"] + s["k"] * 18000).drop("k").toPandas().to_parquet(path / "supplier.parquet")
    return str(path)


def test_fields_follow_waves(spark, sf_dir, tmp_path, monkeypatch):
    d, points, whole = _copies(spark, sf_dir, tmp_path), [], tomography.block_medians
    monkeypatch.setattr(tomography, "block_medians", lambda p, size: points.append(p.count()) or whole(p, size))
    n = QUERIES["eikonal_fields"](spark, d).count()
    # ten waves at ten places, for thirty events
    assert points == [100] and n == 30 * 22 * 16


def test_models_are_solved_once(spark, sf_dir, tmp_path):
    d = _copies(spark, sf_dir, tmp_path)
    x = QUERIES["rayleigh_dispersion"](spark, d)
    assert x.count() == 90 and "Aggregate" in x._jdf.queryExecution().optimizedPlan().toString()
