"""Fill-in-the-middle against a plain cut of the unit list."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seslog.llm import fim

SCHEMA = "doc_id long, text string, n int, fim_text string, TEXT_ string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, c = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:c], units[c:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text, text
    form, output = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 20 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return n, form, len(prefix), len(middle), output, text


def rows():
    r = random.Random(3)
    parts = ["a", "Word", "zebra", " ", "\n", "\r\n", "\0", "é", "中", "😀", "$1", "\\", "<", "<P", "<S", "S>", "M>", ">", "{", "0"]
    out = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 60)))) for i in range(400)]
    out += [(None, "no id"), (None, None), (500, None), (501, ""), (502, "<P>"), (503, "x <M> y"), (7, "again"), (7, "again"), (504, "a1" * 100_000), (505, "a" * 300_000), (506, "\n" * 150_000), (507, "😀b " * 60_000)]
    return [(i, t, 9, "kept", "other") for i, t in out]


def test_equals_the_plain_cut(spark):
    got = fim.transform(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text or "", *map(str, r.fim)) for r in got) == sorted((str(i), t or "", *map(str, brute(i, t))) for i, t, *_ in rows())
    assert {r.fim.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.n == 9 and r.fim_text == "kept" and r.TEXT_ == "other" for r in got)


def test_empty_table_and_other_parameters(spark):
    none = fim.transform(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[-1] == "fim"
    some = spark.createDataFrame([(str(i), "one two three") for i in range(50)], "name string, body string")
    forms = {r.form for r in fim.transform(some, "name", "body", seed=2, changed=100, spm=100, out="made").select("made.form").collect()}
    assert forms == {"spm"}


def test_nothing_is_shuffled(spark):
    plan = fim.transform(spark.createDataFrame(rows(), SCHEMA)).select(F.sha2("fim.restored", 256))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("text", ["<P<S>", "<<S", "<P", "S>x<"])
def test_markers_across_the_cuts(spark, text):
    df = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string")
    assert {r.restored for r in fim.transform(df).select("fim.restored").collect()} == {text}
