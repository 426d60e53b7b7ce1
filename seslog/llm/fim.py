"""Fill-in-the-middle transformation by counted quantifiers: one match per text captures prefix, middle and suffix.

`regexp_count` gives n, the number of units (runs of ASCII letters, and every other code point by itself). The two cuts
a <= c come from the digest of the id, and the pattern of the row is

    \\A((?:unit){a}+)((?:unit){c - a}+)(.*+)\\z

Possessive counts are matched in a loop without a stack of ways back, so a text may have any number of units; units are
taken from left to right, so the groups end where the units of the whole text end. The same replacement that writes the
groups down writes the order of the form.

Everything is one projection over the rows: nothing is shuffled, no key can be hot, and a lost task is simply run again.
The units of the text that is being counted are an array, so a row takes memory in proportion to its own text.

Defined cases: a null text counts as the empty one, and an empty text is plain with n = 0; a null id is drawn as the
empty text; rows that repeat are transformed alike; a text that holds a marker stays plain, so that the markers of an
output are always the ones put there. An empty table gives an empty table. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seslog.llm.common import fresh_name

UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
CHANGED_OF_100, SPM_OF_100 = 90, 20
FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four 32-bit numbers of an id: the first digit groups of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from. Markers are found once each, as no text that holds one is cut."""
    p, s, m = (re.escape(x) for x in (PREFIX, SUFFIX, MIDDLE))
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z", "$2$3$1")
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def transform(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, changed: int = CHANGED_OF_100, spm: int = SPM_OF_100, out: str = "fim") -> DataFrame:
    """df with a struct column `out` (an older one is replaced): n units, form, code points of prefix and middle (null if plain), output and the text rebuilt from it."""
    t, n, a, c, kind, o = (fresh_name(df, f"{out}_{x}") for x in ("text", "n", "low", "high", "form", "output"))
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    counted = df.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(n, F.regexp_count(t, F.lit(UNIT)).cast("long"))
    one, two = h1 % (F.col(n) + 1), h2 % (F.col(n) + 1)
    marked = F.col(t).contains(PREFIX) | F.col(t).contains(SUFFIX) | F.col(t).contains(MIDDLE)
    form = F.when((F.col(t) == "") | marked | (h3 % 100 >= changed), PLAIN).when(h4 % 100 < spm, SPM).otherwise(PSM)
    drawn = counted.withColumns({a: F.least(one, two), c: F.greatest(one, two), kind: form})
    unit = f"(?:{UNIT})"
    pattern = F.concat(F.lit(rf"(?s)\A({unit}{{"), F.col(a), F.lit(rf"}}+)({unit}{{"), F.col(c) - F.col(a), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col(kind) == SPM, f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = drawn.withColumn(o, F.when(F.col(kind) == PLAIN, F.col(t)).otherwise(F.regexp_replace(t, pattern, order)))
    at = lambda mark: F.instr(F.col(o), mark).cast("long")
    prefix = F.when(F.col(kind) == PSM, at(SUFFIX) - len(PREFIX) - 1).when(F.col(kind) == SPM, at(MIDDLE) - at(PREFIX) - len(PREFIX))
    middle = F.when(F.col(kind) != PLAIN, F.length(o) - at(MIDDLE) - len(MIDDLE) + 1)
    values = (F.col(n), F.col(kind), prefix, middle, F.col(o), restore(F.col(o), F.col(kind)))
    return made.withColumn(out, F.struct(*[v.cast("long").alias(k) if k.endswith("chars") else v.alias(k) for k, v in zip(FIELDS, values)])).drop(t, n, a, c, kind, o)
