"""Operator 2: ZIP and ZIP64 directories, range reads, revisits."""

import base64
import hashlib
import io
import zipfile

import pytest

from pitspark.llm import storage, warc


class Memory:
    """What the reader needs of a file."""

    def __init__(self, raw):
        self.raw, self.reads = raw, []

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.reads.append(n)
        return self.raw[at : at + n]


def archive(names, comment=b"", method=zipfile.ZIP_STORED):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, data in names.items():
            z.writestr(zipfile.ZipInfo(name), data, method)
        z.comment = comment
    return raw.getvalue()


CONTENT = {"a.txt": b"first", "dir/é.bin": b"PK\x05\x06" * 9, "empty": b"", "z": bytes(range(256)) * 40}


def check(raw):
    file = Memory(raw)
    found = warc.members(file)
    assert [m.name for m in found] == list(CONTENT)
    for m in found:
        at, size = warc.stored_range(file, m)
        assert raw[at : at + size] == CONTENT[m.name]


@pytest.mark.parametrize("comment", [b"", b"note", b"PK\x05\x06 inside", b"x" * 65535])
def test_directory(comment):
    check(archive(CONTENT, comment))


def test_zip64_directory(monkeypatch):
    plain = archive(CONTENT)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    wide = archive(CONTENT)
    assert b"PK\x06\x06" in wide and b"PK\x06\x07" in wide and b"PK\x06\x06" not in plain
    check(wide)


def test_more_entries_than_16_bits():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(65600):
            z.writestr(f"{i}", b"")
    assert len(warc.members(Memory(raw.getvalue()))) == 65600


def test_refuses_broken_archives():
    with pytest.raises(ValueError):
        warc.members(Memory(b"no archive"))
    with pytest.raises(ValueError):
        warc.members(Memory(b""))
    with pytest.raises(ValueError):
        warc.members(Memory(archive(CONTENT)[:-30]))
    squeezed = Memory(archive({"z": b"a" * 1000}, method=zipfile.ZIP_DEFLATED))
    with pytest.raises(ValueError):
        warc.stored_range(squeezed, warc.members(squeezed)[0])


PAGES = [
    (5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (4, "http://c/\r\nX: y {\"offset\" z", ""), (6, "http://d/", None), (None, "http://e/", "same"),
    (None, None, "only null"), (None, None, "only null"), (7, "http://f/", "é\r\n\r\nWARC/1.1\r\n😀"), (8, "http://g/", "x" * 300_000), (8, "http://g/", "x" * 300_000), (-1, "u", "y"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, sha1 string")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = warc.archived_pages(spark, frame(spark, PAGES)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = []
    for page, _, html in PAGES:
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids else None
        revisit = first is not None and page != first
        want.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_payloads_and_small_packages(spark):
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * (i % 7)) for i in range(400)]
    packages = warc.write_packages(frame(spark, rows), storage.new_folder(spark, "t"), package_bytes=2000)
    assert packages.count() > 5
    got = {r.page_id: r for r in warc.read_records(warc.locate(packages, block_bytes=700)).collect()}
    assert len(got) == 400
    for page, _, html in rows:
        r = got[page]
        source = r if r.record_type == "response" else got[r.refers_to]
        assert source.record_type == "response" and bytes(source.payload).decode() == html and r.payload_digest == digest(html)


def test_least_bytes(spark):
    packages = warc.write_packages(frame(spark, [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")]), storage.new_folder(spark, "t"), least_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_records(warc.locate(packages)).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_empty_table(spark):
    assert warc.archived_pages(spark, frame(spark, [])).count() == 0
