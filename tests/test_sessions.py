import pytest
from pyspark.sql import functions as F

from seslog.functions.text import redact_secrets
from seslog.operators import sessions as ss


def test_control_packets_give_way_to_objectives(spark):
    rows = spark.createDataFrame(
        [("a", "<goal>x", "<goal>y"), ("b", "<goal>x", "plain"), ("c", "own", None), ("d", None, "<goal>z")], "id string, title string, preview string")
    goals = spark.createDataFrame([("a", "ship"), ("c", "other"), ("d", "mend")], "id string, objective string")
    got = {r.id: (r.title, r.preview) for r in ss.correct_titles(rows, goals, "<goal>").collect()}
    assert got == {"a": ("ship", "ship"), "b": ("<goal>x", "plain"), "c": ("own", None), "d": (None, "mend")}


def test_session_rows_prefer_the_index_then_metadata(spark):
    names = ("one", "two", "three")
    files = spark.createDataFrame([(n, f"/r/{n}.jsonl", 5, 10, False) for n in names], "session_id string, file_path string, mtime_ms long, file_size long, archived boolean")
    facts = ("cwd", "originator", "model", "reasoning_effort", "source", "thread_source", "model_provider", "parent_session", "timestamp")
    metadata = spark.createDataFrame([("one", "meta"), ("two", "meta")], "session_id string, title string").withColumns(
        {c: F.lit("1970-01-01T00:00:01Z" if c == "timestamp" else "/p/up.jsonl" if c == "parent_session" else "") for c in facts})
    titles = spark.createDataFrame([("two", "event"), ("three", "")], "session_id string, title string")
    status = spark.createDataFrame([("one", "done")], "session_id string, status string")
    index = spark.createDataFrame([("one", "named", "1970-01-01T00:00:02Z")], "id string, name string, updated_at string")
    got = {r.id: r for r in ss.assemble_sessions(files, metadata, titles, index, status).collect()}
    assert {k: r.title for k, r in got.items()} == {"one": "named", "two": "meta", "three": "three"}
    assert {k: r.updated_ms for k, r in got.items()} == {"one": 2000, "two": 5, "three": 5}
    assert {k: r.parent_session_id for k, r in got.items()} == {"one": "up", "two": "up", "three": None}
    assert got["one"].started_ms == 1000 and got["one"].status == "done" and got["one"].model is None and got["three"].started_ms is None
    plain = {r.id: r.title for r in ss.assemble_sessions(files, metadata, titles, None, status).collect()}
    assert plain == {"one": "meta", "two": "meta", "three": "three"}


@pytest.mark.parametrize(("message", "shown"), [
    ("\n  \r\n see https://me:pw@host/x \nnext", "see https://[redacted]@host/x"),
    ("Authorization : Bearer a.b~c, then BEARER zz", "authorization=Bearer [redacted], then Bearer [redacted]"),
    ("token: abc token=def authorization=Basic x", "token=[redacted] token=[redacted] authorization=[redacted] x"),
    ("authorization:token: abc token=bearer abc end", "authorization=[redacted] token=[redacted] end"),
    ("bearer http://u:p@h/ token", "Bearer [redacted]://[redacted]@h/ token"),
    ("x" * 500 + " token=a", "x" * 500 + " token=[redacted]"),
    ("no secret", "no secret"), ("", ""), (None, ""),
])
def test_credentials_of_the_first_line_are_redacted(spark, message, shown):
    assert spark.createDataFrame([(message,)], "m string").select(redact_secrets(F.col("m")).alias("m")).first().m == shown
