from seslog.operators import tree as tr


def nodes(spark):
    rows = [(1, None, 10, 0), (2, 1, 9, 1), (3, 1, 3, 2), (4, 2, 1, 3), (5, 99, 2, 4), (6, 6, 1, 5), (12, 10, 0, 6), (10, 11, 5, 7), (11, 10, 4, 8), (13, 12, 1, 9)]
    return spark.createDataFrame(rows, "id long, parent_id long, t long, pos long")


def test_lineage_stops_at_missing_parents_and_cycles(spark):
    got = {}
    for r in tr.lineage(nodes(spark)).orderBy("distance").collect():
        got.setdefault(r.id, []).append(r.ancestor_id)
    assert got == {2: [1], 3: [1], 4: [2, 1], 10: [11], 11: [10], 12: [10, 11], 13: [12, 10, 11]}


def test_depth_first_order_with_orphans_and_cycles(spark):
    """True roots come first; of the cycle 10-11 the first listed node above each one is its root."""
    rows = tr.chain_order(nodes(spark), "t", "pos").orderBy("position").collect()
    assert [(r.id, r.depth) for r in rows] == [(1, 0), (3, 1), (2, 1), (4, 2), (5, 0), (6, 0), (12, 0), (13, 1), (10, 0), (11, 1)]


def test_subtree_totals_count_a_cycle_once(spark):
    from pyspark.sql import functions as F

    got = {r.id: (r.threads, r.turns) for r in tr.subtree_totals(nodes(spark), {"turns": F.col("t")}).collect()}
    assert got[1] == (4, 23) and got[10] == (4, 10) and got[6] == (1, 1)


def test_a_deep_tree_is_summed_to_its_leaves(spark):
    from pyspark.sql import functions as F

    chain = spark.range(30).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(1).alias("t"))
    got = {r.id: r.turns for r in tr.subtree_totals(chain, {"turns": F.col("t")}).collect()}
    assert got == {i: 30 - i for i in range(30)}
    assert tr.lineage(chain).filter("id = 29").count() == 29
    assert tr.lineage(chain, 10).filter("id = 29").count() == 10


def test_children_are_included_as_deep_as_the_caller_says(spark):
    from pyspark.sql import functions as F

    chain = spark.range(14).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    rows = tr.included_children(chain, chain.filter("id = 0"), chain, 11).orderBy("depth").collect()
    assert [(r.id, r.unavailable) for r in rows] == [*[(i, None) for i in range(1, 12)], (12, "max-depth")]
