"""Line ranges with authenticated prefixes, and sinks with a commit."""

import hashlib
import json

import pytest

from cairn.sources import commits, line_ranges


def test_lines_of_ranges(spark, tmp_path):
    lines = [json.dumps({"n": i, "text": "é" * (i % 90)}, ensure_ascii=False) for i in range(400)]
    lines[7], lines[30], lines[31] = "", "", "{broken"
    lines[200] = json.dumps({"n": 200, "text": "x" * 9000})  # longer than many ranges
    body = "\n".join(lines).encode()
    (tmp_path / "a.jsonl").write_bytes(body)
    (tmp_path / "b.jsonl").write_bytes(b'{"n":1}\n')
    (tmp_path / "empty.jsonl").write_bytes(b"")
    paths = [str(tmp_path / x) for x in ("a.jsonl", "b.jsonl", "empty.jsonl")]

    def want(data, path):
        out, at = [], 0
        for i, line in enumerate(data.split(b"\n")):
            if line:
                try:
                    event = json.loads(line.decode("utf-8", "replace"))
                except ValueError:
                    event = None
                out.append((path, i, at, None if event is None else event["n"]))
            at += len(line) + 1
        return out

    def got(files, size):
        rows = line_ranges.read_jsonl(spark, files, size).selectExpr("file", "line", "offset", "try_variant_get(event, '$.n', 'int') as n").collect()
        return sorted(map(tuple, rows), key=lambda r: r[:2])

    every = sorted(want(body, paths[0]) + want(b'{"n":1}\n', paths[1]))
    for size in (1, 97, 4096, 1 << 20):
        if size > 1 or len(body) < 100:
            assert got([{"path": p} for p in paths], size) == every
    for cut in (1, 33, len(body) // 2, len(body)):
        prefix = {"path": paths[0], "prefix_bytes": cut, "prefix_sha256": hashlib.sha256(body[:cut]).hexdigest()}
        assert got([prefix], 500) == want(body[:cut], paths[0])
    (tmp_path / "a.jsonl").write_bytes(body + b"\n{}")  # what follows the prefix may change
    assert len(got([prefix], 5000)) == len(want(body, paths[0]))
    for changed in (b"#" + body[1:], body[:100]):
        (tmp_path / "a.jsonl").write_bytes(changed)
        with pytest.raises(Exception, match="has changed"):
            got([prefix], 5000)


def test_every_range_of_a_small_file(tmp_path):
    body = b"a\n\nbcd\n" + b"e" * 50 + b"\nf"
    (tmp_path / "x").write_bytes(body)
    for size in range(1, len(body) + 2):
        found = [x for lo in range(0, len(body), size) for x in line_ranges.lines_from(str(tmp_path / "x"), lo, min(lo + size, len(body)), len(body))]
        assert found == [(0, b"a"), (2, b""), (3, b"bcd"), (7, b"e" * 50), (58, b"f")]


def test_checkpoints(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        commits.read_checkpoint(spark, path)
    assert commits.write_checkpoint(spark.range(3), path) == 1
    assert commits.write_checkpoint(commits.read_checkpoint(spark, path).selectExpr("id + 10 as id"), path) == 2
    assert sorted(r.id for r in commits.read_checkpoint(spark, path).collect()) == [10, 11, 12]
    # a crash while rows are written, before the pointer moves, and before old versions go
    with pytest.raises(Exception):  # noqa: B017
        commits.write_checkpoint(spark.range(3).selectExpr("raise_error('lost') as id"), path)
    assert commits.current_version(spark, path) == 2
    replace = commits.Folder.replace

    def lost(self, name, text):
        raise RuntimeError("lost")

    monkeypatch.setattr(commits.Folder, "replace", lost)
    with pytest.raises(RuntimeError):
        commits.write_checkpoint(spark.range(1), path)
    monkeypatch.setattr(commits.Folder, "replace", replace)
    assert sorted(r.id for r in commits.read_checkpoint(spark, path).collect()) == [10, 11, 12]
    assert commits.write_checkpoint(spark.range(1), path) == 3
    assert commits.read_checkpoint(spark, path).count() == 1
    assert sum(x.startswith("version-") for x in commits.Folder(spark, path).names()) == 2


def test_runs_are_bound(spark, tmp_path):
    path = str(tmp_path / "run")
    with pytest.raises(Exception):  # noqa: B017
        commits.write_run(spark.range(2).selectExpr("raise_error('lost') as id"), {"seed": 1}, path)
    assert commits.Folder(spark, path).exists("PLAN.json") and commits.broken_links(spark, path) == ["unfinished"]
    with pytest.raises(FileExistsError):
        commits.start_run(spark, {"seed": 2}, path)
    path = str(tmp_path / "again")
    manifest = commits.write_run(spark.range(2), {"seed": 1}, path)
    assert manifest["plan_sha256"] == hashlib.sha256((tmp_path / "again" / "PLAN.json").read_bytes()).hexdigest() and commits.broken_links(spark, path) == []
    (tmp_path / "again" / "PLAN.json").write_text("{}")
    (tmp_path / "again" / ".PLAN.json.crc").unlink()
    assert commits.broken_links(spark, path) == ["plan"]
    part = next((tmp_path / "again" / "RESULT").glob("part-*"))
    part.write_text('{"id":7}\n')
    (tmp_path / "again" / "RESULT" / f".{part.name}.crc").unlink()
    assert commits.broken_links(spark, path) == ["plan", "rows"]
