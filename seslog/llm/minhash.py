"""MinHash near-dedup with an LSH forest of sorted signature orders; links are confirmed on full shingle sets.

Words are runs of other than space and ASCII control blanks, A-Z lower-cased; a text's set holds its distinct shingles
of `size` words (the whole sequence if it has fewer). Texts with equal sets are one node.

The forest has 24 trees. A tree sorts all nodes by eight of their 96 signature values, four of its own first. The orders
are range-sorted together, by tree, values and node, so that a crowded stretch is cut like any other. Nodes that share
the first four values are a region. Neighbours in an order whose common prefix holds four values or more are candidates;
besides, a region is followed to the depth (four to eight) at which its branches have at most eight nodes, and there all
pairs are candidates: the depth adapts to how crowded a region is. Candidates are confirmed in rounds: first one pair per
node, then those whose ends are not connected yet.

What the orders do not compare is then compared exactly. Nodes of regions that are over eight nodes, or cut by the border
of a sorted part, and that are still of several components, are joined on their rarest shingles: two sets at the
similarity share one of the first n - ceil(percent * n) + 1 shingles of each, whatever common order the shingles are put
in, and the places of that shingle must leave room for enough common ones. The order is by rarity, counted in a table of
2^20 places. A shingle with up to sixteen such nodes gives its pairs; nodes that share a more frequent one are compared
in blocks of about 2,048 nodes and 2^18 shingles at most, where a task counts all common shingles between two blocks as
matrix products, and returns only links that connect something. No link that the regions hold is missed, and there is no
cap on members or partners.

Two texts at similarity 0.8 share no region with probability (1 - 0.8^4)^24 = 3e-6, less above.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; a null id is
no component's id unless all of its are null; repeated rows share a set; an empty table gives no rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seslog.llm import bitmap
from seslog.llm.arrowtext import Words, blocks, mix
from seslog.llm.common import fresh_name, stage
from seslog.llm.graph import components
from seslog.llm.hotjoin import counted_join

SIZE, PERCENT = 5, 80
TREES, STEP = 24, 4
VALUES = TREES * STEP
DEPTH, SMALL = 2 * STEP, 8
FEW, RARITY_BITS = 16, 20
BLOCK_SHINGLES, BLOCK_NODES, COLUMNS = 1 << 18, 2048, 4096

_odd = np.random.default_rng(20240607).integers(0, 1 << 63, size=(2, VALUES), dtype=np.uint64)
FACTORS, SHIFTS = _odd[0] * np.uint64(2) + np.uint64(1), _odd[1]


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle) of a block of texts, sorted by row and then hash."""
    words = Words(column)
    hashes, rows = words.hashes(), words.rows
    value, at = words.shingles(hashes, size)
    values, owners = [value], [rows[at]]
    for n in range(1, size):
        value, at = words.shingles(hashes, n)
        short = words.counts[rows[at]] == n
        values.append(value[short])
        owners.append(rows[at][short])
    value, row = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[new], value[new]


def _digests(starts: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set: two sums of differently mixed shingles."""
    with np.errstate(over="ignore"):
        a = np.add.reduceat(mix(value), starts)
        return mix(a), mix(np.add.reduceat(mix(value ^ np.uint64(0xD6E8FEB86659FD93)), starts) + a)


def _described(column: pa.Array, size: int):
    row, value = _sets(column, size)
    present, starts = np.unique(row, return_index=True)
    if not len(present):
        return row, value, present, starts, row, row
    first, second = _digests(starts, value)
    return row, value, present, starts, first, second


def _names(first: np.ndarray, second: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in zip(first.tolist(), second.tolist())]


def _signatures(size: int):
    """(doc_id, n, node, slot, signature) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            row, value, present, starts, first, second = _described(batch.column(2), size)
            total = batch.num_rows
            n = np.bincount(row, minlength=total)
            names, slots, signatures = [None] * total, np.zeros(total, dtype=np.int64), [None] * total
            if len(present):
                least = np.empty((len(present), VALUES), dtype=np.uint32)
                with np.errstate(over="ignore"):
                    for j in range(VALUES):
                        least[:, j] = np.minimum.reduceat(((value * FACTORS[j] + SHIFTS[j]) >> np.uint64(32)).astype(np.uint32), starts)
                ids = batch.column(1).to_numpy().view(np.uint64)
                slots[present] = bitmap.slots(mix(first ^ ids[present]))
                for i, name, signature in zip(present.tolist(), _names(first, second), least):
                    names[i], signatures[i] = name, signature.astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(names, pa.string()), pa.array(slots), pa.array(signatures, pa.binary())], ["doc_id", "n", "node", "slot", "signature"]
            )

    return run


def _members(size: int, wanted):
    """(node, members) of rows whose slot is set: the sorted shingle hashes of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in blocks(batches, "text"):
            row, value, present, starts, first, second = _described(batch.column(1), size)
            if not len(present):
                continue
            ids = batch.column(0).to_numpy().view(np.uint64)
            hit = bitmap.is_set(table, bitmap.slots(mix(first ^ ids[present])))
            ends = np.append(starts[1:], len(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_names(first[hit], second[hit]), pa.string()), pa.array([value[a:b].tobytes() for a, b in zip(starts[hit], ends[hit])], pa.binary())], ["node", "members"]
            )

    return run


def _packed(values: np.ndarray) -> np.ndarray:
    """Four values of 16 bits as one number, in their order."""
    out = np.zeros(len(values), dtype=np.uint64)
    for k in range(STEP):
        out = out << np.uint64(16) | values[:, k].astype(np.uint64)
    return out.view(np.int64)


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, high, low, node): the first four and the next four values of a node in each tree's order."""
    for batch in batches:
        if batch.num_rows:
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
            packed = [_packed(signature[:, k * STEP : k * STEP + STEP]) for k in range(TREES)]
            for tree in range(TREES):
                of = pa.array(np.full(batch.num_rows, tree, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([of, pa.array(packed[tree]), pa.array(packed[(tree + 1) % TREES]), batch.column(0)], ["tree", "high", "low", "node"])


def _prefixes(same: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many leading values each row of an order shares with the next one: 0 (fewer than four) or 4 to 8."""
    apart = (low[1:] ^ low[:-1]).view(np.uint64)
    deeper = sum((apart >> np.uint64(16 * k) == 0).astype(np.int64) for k in range(STEP))
    return np.where(same, STEP + deeper, 0)


def _sizes(joined: np.ndarray) -> np.ndarray:
    """The length of the run that each row is in; joined tells which rows belong with their next one."""
    run = np.concatenate([[0], np.cumsum(~joined)])
    return np.bincount(run)[run]


def _neighbours(tree: np.ndarray, high: np.ndarray, low: np.ndarray, opens: bool, closes: bool):
    """Candidate pairs (i, j) of a sorted stretch of whole regions, and which rows need the exact comparison.

    The first region may have begun before the stretch (opens), the last one may go on after it (closes).
    """
    n = len(tree)
    prefix = _prefixes((tree[1:] == tree[:-1]) & (high[1:] == high[:-1]), low)
    depth = np.full(n, STEP)
    for d in range(STEP, DEPTH + 1):
        depth += _sizes(prefix >= d) > SMALL
    at, to, shared = [], [], prefix
    for k in range(1, min(SMALL, n)):
        if k > 1:
            shared = np.minimum(shared[:-1], prefix[k - 1 :])
        found = np.flatnonzero(shared >= (STEP if k == 1 else depth[: n - k]))
        at.append(found)
        to.append(found + k)
    region = np.concatenate([[0], np.cumsum(prefix < STEP)])
    exact = _sizes(prefix >= STEP) > SMALL
    if opens:
        exact |= region == region[0]
    if closes:
        exact |= region == region[-1]
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(at or [none]), np.concatenate(to or [none]), exact


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order: (null, a, b) of candidates and (region, node, null) of rows that need the exact comparison."""

    def found(rows: pa.Table, opens: bool, closes: bool) -> pa.RecordBatch:
        tree, high, low = (rows.column(c).to_numpy() for c in ("tree", "high", "low"))
        i, j, exact = _neighbours(tree, high, low, opens, closes)
        node = rows.column("node").combine_chunks()
        with np.errstate(over="ignore"):
            region = mix(high.view(np.uint64) + mix(tree.astype(np.uint64))).view(np.int64)
        a, b = node.take(pa.array(i)), node.take(pa.array(j))
        regions = pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(region[exact])])
        return pa.RecordBatch.from_arrays([regions, pa.concat_arrays([a, node.filter(pa.array(exact))]), pa.concat_arrays([b, pa.nulls(int(exact.sum()), b.type)])], ["region", "a", "b"])

    held: list[pa.RecordBatch] = []
    opens = True
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, high = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = int(np.flatnonzero((tree != tree[-1]) | (high != high[-1]))[-1]) + 1 if tree[0] != tree[-1] or high[0] != high[-1] else 0
        before = held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (int(tree[-1]), int(high[-1]))
        if last or before:  # a region has begun: all before it is whole
            whole = pa.Table.from_batches([*held, batch.slice(0, last)])
            if whole.num_rows:
                yield found(whole, opens, False)
                opens = False
            held = []
        held.append(batch.slice(last))
    if held:
        yield found(pa.Table.from_batches(held), opens, True)


def _confirmed(percent: int):
    """The pairs whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    return run


def _confirm(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    left = members.select(F.col("node").alias("a"), F.col("members").alias("x"))
    right = members.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "u string, v string"))


def _block_links(percent: int):
    """Links between nodes of different components inside a block, or between two blocks, as far as they connect."""

    def run(rows: pa.Table) -> pa.Table:
        nodes, side = rows.column("node").to_pylist(), rows.column("block").to_numpy()
        root = np.unique(np.array(rows.column("root").to_pylist()), return_inverse=True)[1]
        n = rows.column("n").to_numpy()
        value = np.frombuffer(b"".join(rows.column("members").to_pylist()), dtype=np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        _, column, copies = np.unique(value, return_inverse=True, return_counts=True)
        shared = copies > 1
        place = np.cumsum(shared) - 1
        some = shared[column]
        owner, column = owner[some], place[column[some]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        a = np.flatnonzero(side == rows.column("cell")[0].as_py()["i"])
        b = np.flatnonzero(side == rows.column("cell")[0].as_py()["j"])
        common = np.zeros((len(a), len(b)), dtype=np.float32)
        n_shared = int(shared.sum())
        for low in range(0, n_shared, COLUMNS):
            i, j = np.searchsorted(column, (low, low + COLUMNS))
            has = np.zeros((len(n), min(COLUMNS, n_shared - low)), dtype=np.float32)
            has[owner[i:j], column[i:j] - low] = 1
            common += has[a] @ has[b].T
        linked = (100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)) & (root[a][:, None] != root[b][None, :])
        group = np.arange(int(root.max()) + 1 if len(root) else 0)

        def top(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        found: list[tuple[str, str]] = []
        for i, j in zip(*np.nonzero(linked)):
            x, y = top(root[a[i]]), top(root[b[j]])
            if x != y:
                group[x] = y
                found.append((nodes[a[i]], nodes[b[j]]))
        return pa.table({"u": pa.array([x for x, _ in found], pa.string()), "v": pa.array([y for _, y in found], pa.string())})

    return run


def _mixed(grouped: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (region, node) of groups that hold more than one component: (region, node, root)."""
    rooted = stage(grouped.select("region", "node").join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root")))
    return stage(counted_join(rooted, _several(rooted), ["region"], "many").select("region", "node", "root"))


def _several(rooted: DataFrame) -> DataFrame:
    """(region, many): the size of each group that holds more than one component."""
    sized = rooted.groupBy("region").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high"))
    return stage(sized.filter("low <> high").select("region", "many"))


def _places(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, n) of the shingles of a task's sets."""
    counts = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    for batch in batches:
        for members in batch.column(0):
            np.add.at(counts, _places(np.frombuffer(members.as_buffer(), dtype=np.uint64)), 1)
    place = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts[place])], ["place", "n"])


def _rarity(sets: DataFrame) -> np.ndarray:
    """A table of fixed size (1 MB): how frequent the shingles of each place are, in steps of an eighth of a doubling."""
    found = sets.select("members").mapInArrow(_counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << RARITY_BITS, dtype=np.uint8)
    table[found["place"].to_numpy(dtype=np.int64)] = np.minimum(8 * np.log2(found["n"].to_numpy(dtype=np.float64) + 1), 255).astype(np.uint8)
    return table


def _rarest(percent: int, rarity):
    """(region, node, root, n, at) of the shingles, rarest first, of which a linked set must hold one; the shingle is the region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for batch in batches:
            for node, root, members in zip(*(batch.column(k) for k in range(3))):
                value = np.frombuffer(members.as_buffer(), dtype=np.uint64)
                n = len(value)
                first = value[np.lexsort((value, table[_places(value)]))][: n + percent * n // -100 + 1]
                k = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.repeat(node, k), pa.repeat(root, k), pa.array(np.full(k, n, dtype=np.int64)), pa.array(np.arange(k))], ["region", "node", "root", "n", "at"]
                )

    return run


def _by_rarest(mixed: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components that share a rare enough shingle, and (region, node) of the more frequent ones."""
    sets = stage(mixed.select("node", "root").distinct().join(members, "node").select("node", "root", "members"))
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets))
    rows = stage(sets.mapInArrow(_rarest(percent, rarity), "region long, node string, root string, n long, at long"))
    shared = counted_join(rows, _several(rows), ["region"], "many")
    few = shared.filter(F.col("many") <= FEW).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("node", "root", "n", "at"))).alias("nodes"))
    left = few.select("nodes", F.posexplode("nodes").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(FEW))).alias("b"))
    room = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    enough = room * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))
    pairs = pairs.filter(F.col("a.root") != F.col("b.root")).filter(enough).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return pairs.distinct(), shared.filter(F.col("many") > FEW).select("region", "node")


def _by_blocks(mixed: DataFrame, nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """All links that connect components of mixed groups: groups that share nodes are compared as one."""
    tied = mixed.join(mixed.groupBy("region").agg(F.min("node").alias("least")), "region").select(F.col("node").alias("u"), F.col("least").alias("v"))
    group = components(tied).withColumnRenamed("root", "group")
    sized = mixed.select("node", "root").distinct().join(group, "node").join(nodes.select("node", "n"), "node")
    total = sized.groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_NODES)).alias("blocks"))
    placed = sized.join(total, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(members, "node")
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.struct(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return stage(paired.withColumn("cell", cell).groupBy("group", "cell").applyInArrow(_block_links(percent), "u string, v string"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: doc_id, node (null without words), n_shingles, component_id and kept.

    component_id is the smallest doc_id that is reachable over links of 100 * intersection >= percent * union.
    """
    id_type = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("id_hash"), F.col(text).alias("text"))
    rows = stage(source.mapInArrow(_signatures(size), f"doc_id {id_type}, n long, node string, slot long, signature binary"))
    nodes = stage(
        rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.min_by(F.struct("doc_id", "slot"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("one"), F.first("signature").alias("signature"))
        .select("node", "n", "signature", F.col("one.doc_id").alias("first_id"), F.col("one.slot").alias("slot"))
    )
    ordered = nodes.select("node", "signature").mapInArrow(_orders, "tree int, high long, low long, node string").repartitionByRange("tree", "high", "low", "node")
    scanned = stage(ordered.sortWithinPartitions("tree", "high", "low", "node").mapInArrow(_scan, "region long, a string, b string"))
    crowded = scanned.filter("region IS NOT NULL").select("region", F.col("a").alias("node"))
    pairs = stage(scanned.filter("region IS NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    members = _member_sets(source, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct(), size)
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _confirm(first, members, percent)
    roots = stage(components(links))

    def connect(found: DataFrame) -> None:
        nonlocal links, roots
        if not found.isEmpty():
            links = stage(links.union(found))
            roots = stage(components(links))

    connect(_confirm(_apart(pairs, roots).join(first, ["a", "b"], "left_anti"), members, percent))
    mixed = _mixed(crowded, roots)
    if not mixed.isEmpty():
        rare, frequent = _by_rarest(mixed, members, percent)
        frequent = stage(frequent)
        connect(_confirm(rare, members, percent))
        mixed = _mixed(frequent, roots)
        if not mixed.isEmpty():
            connect(_by_blocks(mixed, nodes, members, percent))
    labelled = nodes.select("node", "first_id").join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component"))
    component = labelled.join(least, "root").select("node", "component")
    # rows without words are their own component; they take no part in the join
    alone = rows.filter("node IS NULL").select("doc_id", "node", "n", F.col("doc_id").alias("component"))
    joined = rows.filter("node IS NOT NULL").join(component, "node").select("doc_id", "node", "n", "component")
    return alone.union(joined).select("doc_id", "node", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _member_sets(source: DataFrame, nodes: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """The full sets of the named nodes, read from one row of each."""
    named = stage(named)
    table = bitmap.collect(nodes.join(named, "node").select("slot"))
    wanted = source.sparkSession.sparkContext.broadcast(table)
    found = source.select("id_hash", "text").mapInArrow(_members(size, wanted), "node string, members binary")
    return stage(found.join(named, "node", "left_semi").dropDuplicates(["node"]))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """df with one row of each group: the row of smallest id (equal rows stay together). All columns are kept."""
    key = fresh_name(df, "row_key")
    keyed = df.withColumn(key, F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(doc_id).cast("string"), F.lit("\x1e")), F.coalesce(F.col(text), F.lit("\x1e"))), 256))
    source = keyed.select(F.struct(F.col(doc_id).alias("doc_id"), F.col(key).alias("key")).alias("id"), F.col(text).alias("text"))
    dropped = near_duplicates(source, "id", "text", size, percent).filter("not kept").select(F.col("doc_id.key").alias(key)).distinct()
    return keyed.join(dropped, key, "left_anti").select(*df.columns)
