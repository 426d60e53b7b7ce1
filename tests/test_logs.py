import os

from conftest import FIXTURES
from pyspark.sql import functions as F

from seslog.sources import logs

GENERIC, PI, UUID = (f"{n * 8}-{n * 4}-4{n * 3}-8{n * 3}-{n * 12}" for n in "124")


def test_lines_indexes_and_bad_json(spark, fixture_records):
    rows = fixture_records.filter(F.col("session_id") == GENERIC).orderBy("event_index").collect()
    assert [r.event_index for r in rows] == list(range(18))
    bad = [r for r in rows if not r.is_valid]
    assert [(r.event_index, r.line_number, r.error_code, r.preview) for r in bad] == [(13, 14, "invalid-json", "{broken json")]


def test_blank_lines_splits_and_tail(spark, tmp_path):
    text = "".join(f'{{"n":{i},"pad":"{"x" * 50}"}}\n' + ("\n" if i % 3 == 0 else "") for i in range(400))
    path = tmp_path / "logs" / "a" / "one.jsonl"
    path.parent.mkdir(parents=True)
    path.write_text(text + '{"n":400')
    (tmp_path / "logs" / ".hidden").mkdir()
    (tmp_path / "logs" / ".hidden" / "two.jsonl").write_text('{"n":1}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        lines = logs.read_lines(spark, str(tmp_path / "logs"))
        assert lines.select("file_path").distinct().count() == 1
        records = logs.parse_records(lines).orderBy("event_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.event_index for r in records] == list(range(401))
    physical = [i + 1 for i, line in enumerate((text + '{"n":400').split("\n")) if line.strip()]
    assert [r.line_number for r in records] == physical
    tail = logs.committed_tail(lines, 1000).filter("NOT blank").orderBy("byte_start").collect()
    start = len(text + '{"n":400') - 1000
    window = (text + '{"n":400')[start:]
    expected = [x for x in window[window.index("\n") + 1: window.rindex("\n")].split("\n") if x.strip()]
    assert [r.line for r in tail] == expected


def test_roots_times_and_archived(spark, tmp_path):
    for name in ("x/sessions", "y/sessions", "x/archived_sessions"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "s.jsonl").write_text('{"a":1}\nnull\n')
    os.utime(tmp_path / "x/sessions/s.jsonl", (1_700_000_000, 1_700_000_000))
    both = logs.read_session_logs(spark, str(tmp_path / "*" / "sessions"), str(tmp_path / "x" / "archived_sessions"))
    assert sorted(r.archived for r in both.collect()) == [False] * 4 + [True] * 2
    assert logs.tolerant_records(both).count() == 3
    since = logs.read_session_logs(spark, str(tmp_path / "*" / "sessions"), since_ms=1_700_000_000_001)
    assert since.select("file_path").distinct().count() == 1
    until = logs.read_session_logs(spark, str(tmp_path / "*" / "sessions"), since_ms=1_700_000_000_000, before_ms=1_700_000_000_001)
    assert until.select("file_path").distinct().count() == 1
    assert logs.dated_paths("/r", "2026-02-27", "2026-03-01") == ["/r/2026/02/27", "/r/2026/02/28", "/r/2026/03/01"]


def test_session_index(spark, tmp_path):
    (tmp_path / "session_index.jsonl").write_text('{"id":"a","thread_name":"one"}\n{"id":"b","name":"two","updatedAt":"2026-01-01T00:00:00Z"}\n{"id":"a","name":"three"}\n')
    rows = {r.id: (r.name, r.updated_at) for r in logs.session_index(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("three", None), "b": ("two", "2026-01-01T00:00:00Z")}


def test_report_sink(spark, tmp_path, fixture_assembly):
    from seslog.sources.sinks import report_lines, write_report

    sessions = spark.createDataFrame([(GENERIC, "T", "completed", 63_000, 1_782_788_400_000)], "session_id string, title string, status string, wall_ms long, start_ms long")
    nodes = spark.createDataFrame([(GENERIC, 0, 0, "turn", 1_782_788_401_000, 12_000)], "session_id string, line_no long, depth int, title string, start_ms long, duration_ms long")
    lines = report_lines(sessions, nodes, fixture_assembly.items.filter(F.col("session_id") == GENERIC))
    write_report(lines, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report" / f"session_id={GENERIC}")).collect())
    assert "- turn +1 s 12 s" in text and "总时长：1m 3s" in text
    assert "工具：exec_command" in text and '{"cmd":"npm test"}' in text
    assert "输出：11 字节" in text and "ok and more" not in text
    assert FIXTURES


def test_dot_folders_count_only_where_a_star_stands(spark, tmp_path):
    for folder in (".codex/sessions", ".codex/.hidden", "plain/sessions"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "44444444-4444-4444-8444-444444444444.jsonl").write_text('{"a": 1}\n')
    from seslog.sources.logs import read_lines

    assert read_lines(spark, f"{tmp_path}/.codex/sessions").count() == 1
    assert read_lines(spark, f"{tmp_path}/.codex/*").count() == 1
    assert read_lines(spark, f"{tmp_path}/*/sessions").count() == 1


def test_scan_of_days_passes_over_absent_folders(spark, tmp_path):
    root = tmp_path / ".codex" / "sessions"
    for day in ("2026/02/27", "2026/03/01", "2026/03/02"):
        (root / day).mkdir(parents=True)
        (root / day / f"{day.replace('/', '-')}.jsonl").write_text('{"n":1}\n')
    read = lambda first, last: sorted(r.session_id for r in logs.read_session_logs(spark, str(root), days=(first, last)).collect())
    assert read("2026-02-27", "2026-03-01") == ["2026-02-27", "2026-03-01"]
    assert read("2025-01-01", "2025-01-02") == []


def test_model_windows_at_any_depth(spark):
    deep = '{"id":"deep","contextWindow":7}'
    for _ in range(12):
        deep = '{"x":[' + deep + ']}'
    docs = spark.createDataFrame([(deep,), ('{"id":"top","contextWindow":1}',), ('{}',)], "t string").select(F.parse_json("t").alias("doc"))
    assert {r.model: r.context_window for r in logs.model_windows(docs).collect()} == {"deep": 7.0, "top": 1.0}
