import random

from pyspark.sql import functions as F

from seslog.operators import intervals as iv
from seslog.operators import timejoin as tj

SCHEMA = "k string, start_ms long, end_ms long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_cover_overlap(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 20), ("a", 30, 40), ("b", 0, 10), ("b", 5, 20), ("b", 8, 12)], SCHEMA)
    assert rows_of(iv.merge_intervals(df, ["k"], 4)) == [("a", 0, 20), ("a", 30, 40), ("b", 0, 20)]
    assert rows_of(iv.sweep_totals(df, ["k"], 4)) == [("a", 30, 5, 2), ("b", 20, 7, 3)]


def test_touching_zero_length_and_reversed(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 12, 12), ("a", 20, 15), ("a", None, 3), ("z", 4, 4)], SCHEMA)
    assert rows_of(iv.merge_intervals(df, ["k"], 3)) == [("a", 0, 9), ("a", 12, 12), ("z", 4, 4)]
    assert rows_of(iv.sweep_totals(df, ["k"], 3)) == [("a", 9, 0, 1), ("z", 0, 0, 0)]


def test_composition_adds_up_to_active_time(spark):
    random.seed(3)
    rows = []
    for i in range(200):
        start = random.randrange(500)
        rows.append(("hot" if i % 3 else "x", start, start + random.randrange(30), random.choice(["llm_wait", "tool_execution"]), random.random() < 0.4))
    df = spark.createDataFrame(rows, SCHEMA + ", bucket string, estimated boolean")
    parts = iv.composition(df, ["k"], ["llm_wait", "tool_execution"], 16).groupBy("k").agg(F.sum("duration_ms").alias("c"))
    both = parts.join(iv.sweep_totals(df, ["k"], 16), "k").collect()
    assert both and all(r.c == r.covered_ms for r in both)


def test_gaps(spark):
    spans = spark.createDataFrame([("a", 2000, 5000), ("a", 2500, 9000), ("a", 9500, 12000)], SCHEMA)
    bounds = spark.createDataFrame([("a", 0, 14000), ("b", 0, 5000)], "k string, lower_ms long, upper_ms long")
    assert rows_of(iv.free_segments(spans, bounds, ["k"], 1000)) == [("a", 0, 2000), ("a", 12000, 14000), ("b", 0, 5000)]
    assert rows_of(iv.unattributed_remainder(spans, bounds, ["k"])) == [("a", 14000 - 3000 - 6500 - 2500), ("b", 5000)]


def test_first_covering_matches_brute_force(spark):
    random.seed(11)
    turns, start = [], 0
    for i in range(40):
        start += random.randrange(0, 12)
        turns.append(("s", i, i, start, None if i == 20 else start + random.randrange(0, 40)))
    jumbled = [("j", i, i, random.randrange(100), random.randrange(100, 160)) for i in range(10)]
    jumbled += [("j", 10, 10, None, 3), ("j", 11, 11, 150, None), ("j", 12, 12, 90, 20)]
    points = [("s", n, random.randrange(-5, 400)) for n in range(200)] + [("j", n, random.randrange(-9, 200)) for n in range(60)] + [("s", 999, None), ("j", 999, None)]
    # points of a real job come out of a shuffle
    got = tj.first_covering(
        spark.createDataFrame(points, "k string, n long, t long").repartition(37), spark.createDataFrame(turns + jumbled, "k string, ord long, interval_id long, start_ms long, end_ms long"), ["k"], 16)

    def brute(k, t):
        for key, _, ident, s, e in turns + jumbled:
            if key == k and t is not None and (s is None or s <= t) and (e is None or t <= e):
                return ident
        return None

    assert {(r.k, r.n): r.interval_id for r in got.collect()} == {(k, n): brute(k, t) for k, n, t in points}
