"""Tiles of the nearest-neighbour join go by shuffle, however small their files are."""

from stratia.llm import neighbours


def test_nearest_broadcasts_no_tiles(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(200)], "vec_id long, embedding array<float>")
    found = neighbours.nearest(rows)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString() and found.count() == 4 * 5
