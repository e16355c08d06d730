"""Numbered lines: every line of a file with its number and offset, broken ones included."""

from __future__ import annotations

import gzip
import io

import pytest

from metricloom.sources import audit_log, line_source


@pytest.mark.parametrize("data", [b"", b"a", b"a\n", b"\n\nb", b"x" * 100 + b"\n" + b"\r\n" + b"last"])
@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_numbers_and_offsets(monkeypatch, data, chunk):
    monkeypatch.setattr(line_source, "CHUNK", chunk)
    rows = list(line_source.numbered(io.BytesIO(data)))
    want = data.split(b"\n")
    want = want[:-1] if want[-1] == b"" else want
    assert [r[0] for r in rows] == want and [r[1] for r in rows] == list(range(1, len(want) + 1))
    assert all(data[o : o + len(line)] == line for line, _, o in rows)


def test_damaged_files(spark, tmp_path):
    good = '{"line_no": %d, "id": "é%d", "action": "error"}'
    plain = tmp_path / "log=a%20b" / "segment=3"
    packed = tmp_path / "log=c" / "segment=0"
    for folder in (plain, packed):
        folder.mkdir(parents=True)
    body = "\n".join([good % (7, 7), "{oops", "", good % (9, 9)]).encode() + b"\n\xff\xfe broken bytes"
    (plain / "part.txt").write_bytes(body)
    (plain / "_SUCCESS").write_bytes(b"not a line\n")
    (packed / "part.txt.gz").write_bytes(gzip.compress(("\n".join(good % (i, i) for i in range(25_000)) + "\n").encode()))
    lines = line_source.read_numbered(spark, str(tmp_path))
    rows = {r["file_line"]: r for r in audit_log.parse_lines(lines.where("log = 'a b'")).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5] and {r["segment"] for r in rows.values()} == {3}
    assert (rows[1]["line_no"], rows[1]["id"], rows[1]["parse_error"]) == (7, "é7", None)
    assert rows[2]["parse_error"] == "malformed JSON in line 2" and rows[5]["parse_error"] == "malformed JSON in line 5"
    at = rows[4]["byte_offset"]
    assert body[at : at + 12] == b'{"line_no": ' and rows[4]["line_no"] == 9
    many = audit_log.parse_lines(lines.where("log = 'c'"))
    assert many.where("parse_error IS NULL AND line_no = file_line - 1").count() == 25_000


def test_empty_folder(spark, tmp_path):
    assert line_source.read_numbered(spark, str(tmp_path)).count() == 0
