"""Parent/child trees: ancestor chains, depth-first order, subtree totals, filters that keep ancestors.

Chains are found by doubling: after step k every node knows up to 2^k ancestors, so a chain of 10 needs four joins
instead of ten. Every step is a key join on the node id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.staging import stage
from seslog.operators.forest import depth_first, subtree_sums


def ancestor_chains(nodes: DataFrame, depth: int | None = None, payload: Sequence[str] = ()) -> DataFrame:
    """Per node ``chain``: ancestors from the parent upwards as structs (id, *payload), and ``cyclic``.

    A parent that is missing from ``nodes`` or equals the node ends the chain; so does an ancestor seen before
    (then ``cyclic`` is true). ``depth`` bounds the chain; None follows it to its end.
    """
    entry = F.struct(F.col("id"), *[F.col(c) for c in payload])
    base = nodes.select("id", F.col("parent_id").alias("__parent"), *payload)
    parents = base.select(F.col("id").alias("__parent"), entry.alias("__entry"))
    linked = base.join(parents, "__parent", "left").select(
        "id", *payload, F.when(F.col("__parent") != F.col("id"), F.col("__entry")).alias("__entry")
    )
    state = stage(
        linked.select(
            "id", *payload,
            F.when(F.col("__entry").isNotNull(), F.array("__entry")).otherwise(F.array().cast(_chain_type(linked))).alias("chain"),
            F.col("__entry").isNotNull().alias("open"),
            F.lit(False).alias("cyclic"),
        )
    )
    reach = 1
    while depth is None or reach < depth:
        if depth is None and state.filter("open").isEmpty():
            break
        upper = state.select(F.col("id").alias("__top"), F.col("chain").alias("__up"), F.col("open").alias("__open"),
                             F.col("cyclic").alias("__cyc"))
        # Closed chains are done; keeping them out of the join also keeps their null keys out of one partition.
        step = (
            state.filter("open").withColumn("__top", F.element_at("chain", -1)["id"])
            .join(upper, "__top", "left")
            .withColumns({
                "__known": F.concat(F.array("id"), F.transform("chain", lambda e: e["id"])),
                "__up": F.coalesce("__up", F.array().cast(_chain_type(linked))),
            })
            .withColumn("__repeats", F.arrays_overlap("__known", F.transform("__up", lambda e: e["id"])))
        )
        state = stage(
            step.select(
                "id", *payload,
                F.concat("chain", F.filter("__up", lambda e: ~F.array_contains("__known", e["id"]))).alias("chain"),
                (F.coalesce("__open", F.lit(False)) & ~F.col("__repeats")).alias("open"),
                (F.col("cyclic") | F.col("__repeats") | F.coalesce("__cyc", F.lit(False))).alias("cyclic"),
            ).unionByName(state.filter("NOT open"))
        )
        reach *= 2
    if depth is not None:
        state = state.withColumn("chain", F.slice("chain", 1, depth))
    return state.drop("open")


def _chain_type(linked: DataFrame) -> str:
    return f"array<{linked.schema['__entry'].dataType.simpleString()}>"


def lineage(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per (node, ancestor): distance 1 is the parent. All ancestors, unless the caller names a depth."""
    chains = ancestor_chains(nodes, depth)
    return chains.select("id", F.posexplode("chain").alias("pos", "e")).select(
        "id", (F.col("pos") + 1).alias("distance"), F.col("e.id").alias("ancestor_id")
    )


def chain_order(nodes: DataFrame, time: str, order: str) -> DataFrame:
    """Depth-first `position` of each node, with `depth` and `root_id`; see forest.depth_first."""
    return depth_first(nodes, time, order)


def descendants(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per (ancestor_id, id, distance), distance 0 being the node itself."""
    chains = ancestor_chains(nodes, depth)
    steps = F.concat(F.array("id"), F.transform("chain", lambda e: e["id"]))
    return chains.select("id", F.posexplode(steps).alias("distance", "ancestor_id"))


def subtree_totals(nodes: DataFrame, measures: dict[str, Column], depth: int | None = None) -> DataFrame:
    """Sums over each node and its descendants (down to ``depth`` where it is given); a session repeated by a cycle counts once."""
    if depth is None:
        return subtree_sums(nodes, {"threads": F.lit(1).cast("long"), **measures})
    values = nodes.select("id", *[expr.alias(name) for name, expr in measures.items()])
    return (
        descendants(nodes, depth).join(values, "id").groupBy(F.col("ancestor_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("threads"), *[F.sum(name).alias(name) for name in measures])
    )


def keep_with_ancestors(nodes: DataFrame, condition: Column) -> DataFrame:
    """Nodes that match and all nodes above them: those with a match in their subtree."""
    hits = subtree_sums(nodes, {"__hits": F.when(condition, 1).otherwise(0).cast("long")}).filter("__hits > 0")
    return nodes.join(hits.select("id"), "id", "left_semi")


def included_children(nodes: DataFrame, roots: DataFrame, sessions: DataFrame, max_depth: int) -> DataFrame:
    """Children of each root down to max_depth, with the reason why one is not loaded.

    A child one level below the bound is listed as a placeholder ('max-depth'); one without a session row is
    'missing-session', and nothing below it is listed.
    """
    present = sessions.select("id", F.lit(True).alias("__present"))
    chains = ancestor_chains(nodes, max_depth + 1).join(present, "id", "left")
    pairs = chains.select("id", "__present", "chain", F.posexplode("chain").alias("pos", "e")).select(
        "id", "__present", F.col("e.id").alias("root_id"), (F.col("pos") + 1).alias("depth"),
        F.slice(F.transform("chain", lambda e: e["id"]), 1, F.col("pos")).alias("between"),
    )
    scoped = pairs.join(roots.select(F.col("id").alias("root_id")), "root_id", "left_semi")
    # A node is reached only through loaded nodes.
    links = scoped.select("root_id", "id", F.explode_outer("between").alias("via")).filter("via IS NOT NULL")
    broken = links.join(sessions.select(F.col("id").alias("via")), "via", "left_anti").select("root_id", "id").distinct()
    return scoped.join(broken, ["root_id", "id"], "left_anti").select(
        "root_id", "id", "depth",
        F.when(F.col("depth") > max_depth, "max-depth").when(F.col("__present").isNull(), "missing-session").alias("unavailable"),
    )


def hierarchy(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """Per thread its (first) parent with title, number of children, and the sibling group it belongs to.

    Siblings are the rows of the same parent group; they are counted, not paired with each other, so a parent with
    very many children stays linear.
    """
    usable = edges.filter("parent_id IS NOT NULL AND child_id IS NOT NULL")
    parent = usable.groupBy(F.col("child_id").alias("id")).agg(F.min("parent_id").alias("parent_id"))
    sizes = usable.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))
    titles = threads.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    own = sizes.select(F.col("parent_id").alias("id"), "n_children")
    group = sizes.select("parent_id", F.col("n_children").alias("n_siblings"))
    return (
        threads.join(parent, "id", "left").join(titles, "parent_id", "left").join(own, "id", "left")
        .join(group, "parent_id", "left")
        .select("id", "title", "parent_id", "parent_title", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("n_siblings", F.lit(0)).alias("n_siblings"))
    )


def siblings_of(threads: DataFrame, edges: DataFrame, thread_id) -> DataFrame:
    """The sibling rows of one thread, itself marked active."""
    parent = edges.filter(F.col("child_id") == thread_id).agg(F.min("parent_id").alias("parent_id"))
    group = edges.join(F.broadcast(parent), "parent_id", "left_semi")  # one row
    named = threads.select(F.col("id").alias("child_id"), "title")
    return group.join(named, "child_id", "left").select(
        F.col("child_id").alias("id"), "title", (F.col("child_id") == thread_id).alias("active")
    )
