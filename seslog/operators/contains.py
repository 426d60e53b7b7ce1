"""Which names a text holds: groups of few names are tried, crowded ones have an inverted index over grams.

Where a group has at most `FEW` names of at most `FEW_CHARS` characters in all, each of its texts is compared with all of them
in one join on the group: a bounded number of tests a text, and only true matches come out. In a crowded group texts times
names would grow with the square of the group. There a name is looked up by one gram of it, its first `GRAM` characters or
fewer, where it is longer the one that the fewest texts of its group hold. Texts give their grams of the lengths that names of
their group have. Candidates are confirmed on the whole name, so a name of up to `GRAM` characters has no false candidates,
and what is joined grows with the characters of the texts and the true matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.functions.staging import stage

GRAM = 12
FEW, FEW_CHARS = 256, 1 << 20


def _grams(text: Column, size: Column) -> Column:
    """Hashes of the distinct grams of one length; none where the text is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substr(text, i, size))))


def contained_names(texts: DataFrame, names: DataFrame, group: str, keys: list[str], text: str = "text", name: str = "name") -> DataFrame:
    """(group, keys, name): the distinct names of a group that the text of its row `keys` holds. Empty names hold nowhere."""
    known = stage(names.select(group, F.col(name).alias("__name")).filter((F.col("__name") != "") & F.col(group).isNotNull()).distinct())
    sizes = known.groupBy(group).agg(F.count("*").alias("__n"), F.sum(F.length("__name")).alias("__chars"))
    crowded = stage(sizes.filter((F.col("__n") > FEW) | (F.col("__chars") > FEW_CHARS)).select(group))
    rows = texts.select(group, *keys, F.col(text).alias("__text")).dropna(subset=[group, *keys])
    held = F.contains("__text", F.col("__name"))
    if crowded.isEmpty():
        found = rows.join(known, group).filter(held).select(group, *keys, "__name")
    else:
        rows = stage(rows)
        few = rows.join(known.join(crowded, group, "left_anti"), group).filter(held).select(group, *keys, "__name")
        found = few.unionByName(_indexed(rows.join(crowded, group, "left_semi"), known.join(crowded, group, "left_semi"), group, keys))
    return found.distinct().withColumnRenamed("__name", name)


def _indexed(rows: DataFrame, known: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """(group, keys, __name) by grams; a row may come more than once."""
    known = known.withColumn("__size", F.least(F.length("__name"), F.lit(GRAM)))
    lengths = known.groupBy(group).agg(F.collect_set("__size").alias("__sizes"))  # at most GRAM numbers a group
    held = rows.join(lengths, group).select(group, *keys, "__text", F.explode("__sizes").alias("__size")).select(
        group, *keys, "__size", F.explode(_grams(F.col("__text"), F.col("__size"))).alias("__gram"))
    asked = known.select(group, "__name", "__size", F.explode(_grams(F.col("__name"), F.col("__size"))).alias("__gram"))
    often = held.join(asked.select(group, "__size", "__gram").distinct(), [group, "__size", "__gram"], "left_semi").groupBy(group, "__size", "__gram").agg(F.count("*").alias("__n"))
    # a name with a gram that no text holds is in no text; of the others the rarest gram stands for the name
    rarest = asked.join(often, [group, "__size", "__gram"], "left").groupBy(group, "__name", "__size").agg(
        F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram"), F.bool_and(F.col("__n").isNotNull()).alias("__all")).filter("__all").drop("__all")
    found = held.join(rarest, [group, "__size", "__gram"]).select(group, *keys, "__name")
    return found.join(rows, [group, *keys]).filter(F.contains("__text", F.col("__name"))).select(group, *keys, "__name")
