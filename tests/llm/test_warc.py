from __future__ import annotations

import hashlib
import os
import random
import zipfile

import pytest

from lodestar.llm import warc

from . import cases

SCHEMA = "page_id long, url string, html string, sha string, first long"


def rows():
    big = "<p>" + cases.prose(4, 60) + "</p>"
    out = [(1, "http://a/ x\r\ny", big), (0, None, big), (2, "u", None), (3, "u", ""), (4, "", "short"), (5, "v", "short"), (6, "é", "é" * 50), (7, "é", "é" * 50), (8, "z", "é" * 49 + "x"), (9, "z", "é" * 49 + "x"), (None, "n", big), (10, "L", "x" * 300_000), (11, "r", "\r\n\r\nWARC/1.1\x00"), (12, "t", big), (12, "t", big)]
    return [(p, u, h, "clash", 1) for p, u, h in out]


def brute(pages):
    firsts = {}
    for p, _, h, *_ in pages:
        if p is not None:
            firsts[h or ""] = min(p, firsts.get(h or "", p))
    out = []
    for p, _, h, *_ in pages:
        payload = (h or "").encode()
        revisit = len(payload) >= 100 and p is not None and firsts[h or ""] != p
        out.append((p, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", firsts[h or ""] if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = cases.frame(spark, tmp_path / "p", rows(), SCHEMA)
    for most in (warc.PACKAGE_BYTES, 500):
        manifest = warc.write_packages(pages, f"file://{tmp_path}/w{most}", package_bytes=most)
        got = warc.read_packages(manifest).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows())
        texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
        assert all(bytes(texts[p]) == (h or "").encode() for p, _, h, *_ in rows() if p in (0, 2, 3, 4, 5, 6, 8, 10, 11))
    assert manifest.count() > 3
    empty = cases.frame(spark, tmp_path / "e", [], SCHEMA)
    assert warc.round_trip(spark, empty).count() == 0


def test_packages_are_plain_zip_archives(tmp_path):
    writer = warc.PackageWriter(f"file://{tmp_path}/x")
    for k in range(30):
        writer.add(warc.record(k, f"http://h/{k}", random.Random(k).randbytes(500), None), {"id": k})
    uri, count, size = writer.close()
    path = uri.removeprefix("file://")
    with zipfile.ZipFile(path) as archive:
        assert archive.testzip() is None and set(archive.namelist()) == {warc.DATA, warc.INDEX}
    assert count == 30 and [r.page_id for r in warc.records(uri)] == list(range(30))


def test_zip64_records_comments_and_other_members(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = tmp_path / "z.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for k in range(5):
            archive.writestr(f"m{k}", bytes([k]) * (90 + 30 * k))
        archive.writestr(zipfile.ZipInfo("packed"), b"a" * 999, zipfile.ZIP_DEFLATED)
        archive.comment = b"a comment"
    store, name = warc.opened(str(path))
    with store.open_input_file(name) as file:
        found = warc.members(file)
        assert set(found) == {f"m{k}" for k in range(5)}
        for k in range(5):
            m = found[f"m{k}"]
            assert file.read_at(m.size, m.start) == bytes([k]) * (90 + 30 * k)


def test_damage_is_reported(tmp_path):
    import gzip

    packed = gzip.compress(warc.record(1, "u", b"payload", None).replace(b"payload", b"paylosd"))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(packed)
    (tmp_path / "n").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="end record"):
        list(warc.records(str(tmp_path / "n")))


def test_payloads_longer_than_a_range(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    writer = warc.PackageWriter(f"file://{tmp_path}/x")
    payloads = [random.Random(k).randbytes(n) for k, n in enumerate((10, 9000, 0, 1500, 700, 30_000))]
    for k, payload in enumerate(payloads):
        writer.add(warc.record(k, None, payload, None), {"id": k})
    uri, _, _ = writer.close()
    assert [r.payload for r in warc.records(uri)] == payloads


def test_packages_are_read_one_per_task_and_removed(spark, tmp_path, monkeypatch):
    pages = cases.frame(spark, tmp_path / "p", [(k, "u", f"page {k} " * 40, "s", 1) for k in range(60)], SCHEMA)
    manifest = warc.write_packages(pages, f"file://{tmp_path}/w", package_bytes=300)
    read = warc.read_packages(manifest)
    assert manifest.count() > 10 and read.rdd.getNumPartitions() == manifest.count()
    folders = []
    path = warc.scratch_path
    monkeypatch.setattr(warc, "scratch_path", lambda s, n: folders.append(path(s, n)) or folders[-1])
    out = warc.round_trip(spark, pages, ("page_id", "record_type"))
    assert out.columns == ["page_id", "record_type"] and out.count() == 60
    assert len(folders) == 1 and not os.path.exists(folders[0].removeprefix("file://"))
