"""Secret scans: fixed patterns, and values beside credential words whose guess cost is high.

The guess cost of a value is the least log10 of guesses over all ways to cut it into common words, dates, repeats,
keyboard walks, alphabet runs and brute-force characters (dynamic programming over its characters; the work grows in
proportion to the length). A value beside a credential word is a secret if its cost reaches `LEAST_COST`, so that
"password: letmein2020" is left alone and a random one of the same length is found.

Spans are (kind, start, end) in code points, end exclusive; `assign`, `access` and `hex` are the matches of the fixed
patterns, `guess` a value found by its cost that overlaps none of them.

Defined cases: a null text is empty and has no spans; rows may repeat, ids may be null; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seslog.llm.arrowtext import blocks

# The base patterns, and the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
KINDS = ["assign", "access", "hex", "guess"]

CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)s?["'\]]?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*["'`]?([^\s"'`<>(){},;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
LEAST_COST = 10.0

# Frequent parts of passwords and of placeholders, most frequent first.
WORDS = (
    "password pass word admin root user login test example sample your here secret token key api access private public "
    "letmein welcome changeme default qwerty monkey dragon master hello love sunshine princess football baseball "
    "shadow michael jordan superman batman trustno iloveyou abc summer winter spring autumn dummy placeholder redacted "
    "none null true false string value insert todo my the this that new old server client prod dev staging database db"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("@4301$5!7", "aaeoissit")
ROWS_OF_KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", re.ASCII)
DATE_LENGTHS = (4, 6, 7, 8, 10)
JOIN = math.log10(2)


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS_OF_KEYS):
        for x, key in enumerate(row):
            for dy, dx in ((0, -1), (0, 1), (1, -1), (1, 0), (-1, 0), (-1, 1)):
                if 0 <= y + dy < len(ROWS_OF_KEYS) and 0 <= x + dx < len(ROWS_OF_KEYS[y + dy]):
                    near.setdefault(key, set()).add(ROWS_OF_KEYS[y + dy][x + dx])
    return near


NEAR = _neighbours()


def _brute(char: str) -> float:
    return 1.0 if char.isdigit() else math.log10(26) if char.islower() else math.log10(36)


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of a value takes."""
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a few letters change their length
        lower = value
    plain = lower.translate(LEET)
    best = [0.0] + [math.inf] * n
    walk = step = 0  # begins of the keyboard walk and of the alphabet run that end here
    same = [0] * 9  # for each period, how many characters in a row repeat the one a period before
    for i in range(1, n + 1):
        at = i - 1
        cost = best[at] + _brute(value[at])
        for length in range(3, min(LONGEST, i) + 1):
            word = lower[i - length : i]
            rank = RANK.get(word)
            leet = 0.0
            if rank is None:
                rank, leet = RANK.get(plain[i - length : i]), JOIN
            if rank:
                case = 0.0 if value[i - length : i] == word else JOIN
                cost = min(cost, best[i - length] + math.log10(rank + 1) + case + leet + JOIN)
        for length in DATE_LENGTHS:
            if length <= i and value[at].isdigit() and DATE.fullmatch(value, i - length, i):
                cost = min(cost, best[i - length] + math.log10(100 if length == 4 else 36500) + JOIN)
        for period in range(1, 9):
            same[period] = same[period] + 1 if at >= period and value[at] == value[at - period] else 0
            run = same[period] // period * period  # whole repeats of the unit before them
            if run and run >= 2:
                cost = min(cost, best[i - run] + math.log10(run // period + 1) + JOIN)
        walk = walk if at and lower[at] in NEAR.get(lower[at - 1], ()) else at
        if i - walk >= 4:
            cost = min(cost, best[walk] + math.log10(47 * 6 * (i - walk)) + JOIN)
        step = step if at and at - step >= 1 and ord(lower[at]) - ord(lower[at - 1]) == ord(lower[step + 1]) - ord(lower[step]) in (1, -1) else (at - 1 if at and abs(ord(lower[at]) - ord(lower[at - 1])) == 1 else at)
        if i - step >= 4:
            cost = min(cost, best[step] + math.log10(26 * 2 * (i - step)) + JOIN)
        best[i] = cost
    return best[n]


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, end) of all spans in order."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
            found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    taken = sorted((a, b) for a, _, b in found)
    ends, reach = [], 0
    for _, b in taken:
        reach = max(reach, b)
        ends.append(reach)
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        if not _overlaps(taken, ends, a, b) and guess_cost(m.group(1).rstrip(".:!?")) >= LEAST_COST:
            found.append((a, 3, a + len(m.group(1).rstrip(".:!?"))))
    return sorted(found)


def _overlaps(taken: list[tuple[int, int]], ends: list[int], a: int, b: int) -> bool:
    from bisect import bisect_left

    before = bisect_left(taken, (b, 0))
    return before > 0 and ends[before - 1] > a


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with a column `out`: its texts' spans, an array of (kind, start, end) in order."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t)] if t else [] for t in texts]
            yield batch.append_column(out, pa.array(rows, pa.list_(item)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(span))]))
