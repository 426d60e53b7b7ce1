"""Totals and positions of trees against a plain walk, on random forests with cycles, a long chain and a star."""

import random

import pytest
from pyspark.sql import functions as F

from seslog.operators import forest
from seslog.operators import tree as tr

SCHEMA = "id long, parent_id long, t long, pos long"


def random_nodes(seed):
    r = random.Random(seed)
    n = r.randint(1, 40)
    ids = r.sample(range(100), n)
    rows = [(i, r.choice([None, i, r.choice(ids), r.choice(ids), r.choice(ids), 999]), r.choice([None, 1, 2, 3]), p) for p, i in enumerate(ids)]
    r.shuffle(rows)
    return rows


def walk(rows):
    """(id, depth) in depth-first order: roots first, then whatever cycles leave over, each in list order."""
    known = {x[0]: x for x in rows}
    listed = sorted(rows, key=lambda x: x[3])
    has_parent = lambda x: x[1] in known and x[1] != x[0]
    children = {}
    for x in sorted(listed, key=lambda x: (x[2] or 0, x[3])):
        if has_parent(x):
            children.setdefault(x[1], []).append(x)
    out, seen = [], set()
    for start in [x for x in listed if not has_parent(x)] + listed:
        stack = [(start, 0, start[0])]
        while stack:
            x, depth, root = stack.pop()
            if x[0] in seen:
                continue
            seen.add(x[0])
            out.append((x[0], root, depth))
            stack += [(c, depth + 1, root) for c in reversed(children.get(x[0], []))]
    return out


def below(rows):
    known = {x[0] for x in rows}
    children = {}
    for i, p, *_ in rows:
        if p in known and p != i:
            children.setdefault(p, []).append(i)
    out = {}
    for i in known:
        seen, stack = set(), [i]
        while stack:
            if (x := stack.pop()) not in seen:
                seen.add(x)
                stack += children.get(x, [])
        out[i] = seen
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_forests_with_cycles(spark, seed):
    rows = random_nodes(seed)
    nodes = spark.createDataFrame(rows, SCHEMA)
    got = forest.depth_first(nodes, "t", "pos").orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert [(r.id, r.root_id, r.depth) for r in got] == walk(rows)
    sums = {r.id: (r.n, r.s) for r in forest.subtree_sums(nodes, {"n": F.lit(1), "s": F.col("t")}).collect()}
    time = {x[0]: x[2] or 0 for x in rows}
    assert sums == {i: (len(b), sum(time[x] for x in b)) for i, b in below(rows).items()}


def test_a_long_chain(spark):
    n = 1_000  # the same at 100,000 takes 17 rounds instead of 10
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(1).cast("long").alias("t"), F.col("id").alias("pos"))
    assert forest.depth_first(chain, "t", "pos").filter("position <> id OR depth <> id OR root_id <> 0").count() == 0
    assert forest.subtree_sums(chain, {"n": F.lit(1).cast("long")}).filter(f"n <> {n} - id").count() == 0
    kept = tr.keep_with_ancestors(chain, F.col("id") == n // 2)
    assert kept.count() == n // 2 + 1


def test_a_star(spark):
    n = 100_000
    star = spark.range(n).select("id", F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_id"), (-F.col("id")).alias("t"), F.col("id").alias("pos"))
    placed = forest.depth_first(star, "t", "pos")
    assert placed.filter(f"id > 0 AND (position <> {n} - id OR depth <> 1)").count() == 0 and placed.count() == n


def test_no_nodes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert forest.depth_first(none, "t", "pos").count() == 0 and forest.subtree_sums(none, {"n": F.lit(1)}).count() == 0
