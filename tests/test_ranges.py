"""Byte-range reads of logs: whole records once, however a file is cut; tails that cost their window; streams over restarts."""

import io
import random

import pytest
from conftest import FIXTURES
from pyspark.sql import functions as F
from test_logs import UUID

from seslog.operators import turns as tn
from seslog.sources import ranges, sinks
from seslog.sources.logs import TAIL_BYTES


class Counting(io.BytesIO):
    taken = 0

    def read(self, size=-1):
        data = super().read(size)
        self.taken += len(data)
        return data


def log(r, records, longest=60):
    lines = [b"" if r.random() < 0.1 else b"x" * r.randint(0, longest) + str(i).encode() for i in range(records)]
    return b"".join(line + b"\n" for line in lines) + r.choice([b"", b'{"half'])


def test_ranges_that_touch_give_every_record_once():
    for seed in range(150):
        r = random.Random(seed)
        data = log(r, r.randint(0, 40))
        cuts = sorted({0, len(data), *(r.randint(0, len(data)) for _ in range(r.randint(0, 8)))})
        chunk = r.choice([1, 3, 16, 1000])
        got = [x for a, b in zip(cuts, cuts[1:]) for x in ranges.read_range(io.BytesIO(data), a, b, chunk)]
        want, at = [], 0
        for line in data.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want, seed


def test_a_tail_reads_its_window_and_no_more():
    for seed in range(150):
        r = random.Random(seed)
        data = log(r, r.randint(0, 60))
        window, chunk = r.randint(1, 400), r.choice([1, 7, 1000])
        file = Counting(data)
        got = list(ranges.read_tail(file, len(data), window, chunk))
        start = max(len(data) - window, 0)
        first = 0 if start == 0 else data.find(b"\n", start) + 1 if data.find(b"\n", start) >= 0 else len(data)
        last = data.rfind(b"\n") + 1
        want = data[first:last].split(b"\n")[:-1] if first < last else []
        assert [line for _, line in got] == want, seed
        assert all(data[b : b + len(line)] == line for b, line in got)
        assert file.taken <= window
    # one record longer than the window: nothing of it is whole
    file = Counting(b"a\n" + b"x" * 10_000 + b"\n")
    assert list(ranges.read_tail(file, 10_003, 100)) == [] and file.taken <= 100


def test_tasks_have_bounded_bytes_and_files():
    parts = [(f"f{i}", 0, size, 0, size) for i, size in enumerate([0, 5, 1000, 3] + [1] * 600)]
    tasks = ranges.pack(parts, 100)
    assert all(sum(b - a for *_, a, b in t.parts) <= 100 and len(t.parts) <= ranges.FILES_PER_TASK for t in tasks)
    assert sum(b - a for t in tasks for *_, a, b in t.parts) == 1608


def test_tail_status_equals_the_status_of_the_whole_logs(spark, fixture_assembly):
    whole = {r.session_id: r.status for r in tn.session_status(fixture_assembly.turns).collect()}
    whole[UUID] = "running"  # the answer in its last line is not committed: the file has no final newline
    records = ranges.tail_records(spark, FIXTURES, TAIL_BYTES)
    newest = records.agg(F.max("mtime_ms")).first()[0]
    stale = {r.session_id: r.status for r in tn.tail_status(records, newest + 31 * 60_000).collect()}
    assert stale == {k: "stopped" if v == "running" else v for k, v in whole.items()}


def test_a_stream_gives_each_record_once_over_restarts(spark, tmp_path):
    folder, path = tmp_path / "sessions" / "2026", tmp_path / "sessions" / "2026" / "a.jsonl"
    folder.mkdir(parents=True)
    (folder / ".dots").mkdir()
    path.write_bytes(b'{"n":0}\n\n{"n":1}\r\n{"n":')

    def run():
        stream = ranges.stream_records(spark, str(tmp_path / "sessions"), range_bytes=5).select("session_id", "byte_start", "line", "is_valid")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.session_id, r.byte_start, r.line, r.is_valid) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a", 0, '{"n":0}', True), ("a", 9, '{"n":1}', True)]
    assert run() == first
    assert run() == first
    with path.open("ab") as file:
        file.write(b'2}\n{bad\n{"n":4')
    (folder / "b.jsonl").write_bytes(b'{"n":9}\n')
    second = [*first, ("a", 18, '{"n":2}', True), ("a", 26, "{bad", False), ("b", 0, '{"n":9}', True)]
    assert run() == second
    with path.open("ab") as file:
        file.write(b"4}\n")
    assert run() == sorted([*second, ("a", 31, '{"n":44}', True)])


def test_an_empty_root(spark, tmp_path):
    assert ranges.tail_records(spark, str(tmp_path / "none")).count() == 0
    assert ranges.committed_records(spark, str(tmp_path)).count() == 0


def test_packed_reports(spark, tmp_path):
    lines = spark.createDataFrame([(f"s{i % 300}", i // 300 % 3, i, f"line {i}\nof 中") for i in range(3000)], "session_id string, part int, line_no long, text string")
    path = str(tmp_path / "report")
    sinks.write_packed_report(lines, path, file_bytes=5000)
    files = list((tmp_path / "report" / "data").glob("*.txt"))
    assert 5 <= len(files) <= 3000 * 19 // 5000 + 3  # by bytes, not by sessions
    (tmp_path / "report" / "data" / "left-behind.txt").write_text("of a task that failed")
    want = {s: "\n".join(f"line {i}\nof 中" for i in sorted((i for i in range(3000) if f"s{i % 300}" == s), key=lambda i: (i // 300 % 3, i))) for s in ("s0", "s7", "s299")}
    for ids in (None, list(want)):
        got = {}
        for row in sorted(sinks.read_packed_report(spark, path, ids).collect(), key=lambda r: (r.part, r.line_no)):
            got[row.session_id] = f"{got[row.session_id]}\n{row.text}" if row.session_id in got else row.text
        assert len(got) == (300 if ids is None else 3) and all(got[s] == text for s, text in want.items())


@pytest.mark.parametrize("root", ["file:{}/*/s", "file://{}/*/s", "{}/*/s"])
def test_stars_and_schemes(spark, tmp_path, root):
    for place in ("a/s", "b/s/deep", ".c/s"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "x.jsonl").write_text('{"a":1}\n')
    assert ranges.committed_records(spark, root.format(tmp_path)).count() == 2
