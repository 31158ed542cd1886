"""Pictures by their headers: what is refused is not read."""

import os
import struct

import numpy as np
import pyarrow.fs
import pytest
from conftest import png_bytes
from pyspark.sql import datasource as DS

from verigauge.sources import pictures as P


def jpeg(width, height, pad=0):
    """Headers of a JPEG with a large comment before the frame."""
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    while pad > 0:
        out += b"\xff\xfe" + struct.pack(">H", min(pad, 60_000) + 2) + bytes(min(pad, 60_000))
        pad -= 60_000
    return out + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, height, width) + bytes(10)


FILES = {
    "a.png": (png_bytes(np.zeros((20, 30, 3), np.uint8)), "png", 30, 20),
    "b.JPG": (jpeg(640, 480, 150_000), "jpeg", 640, 480),
    "c.gif": (b"GIF89a" + struct.pack("<HH", 7, 9) + bytes(3000), "gif", 7, 9),
    "sub/d.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 11, -13) + bytes(50), "bmp", 11, 13),
    "e.webp": (b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + struct.pack("<I", 99)[:3] + struct.pack("<I", 49)[:3], "webp", 100, 50),
    "f.webp": (b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(5) + struct.pack("<I", 11 | 5 << 14), "webp", 12, 6),
    "g.webp": (b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(10) + struct.pack("<HH", 33, 44), "webp", 33, 44),
    "h.tif": (b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHIHxx", 256, 3, 1, 70) + struct.pack("<HHII", 257, 4, 1, 80), "tiff", 70, 80),
    "i.tiff": (b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 2) + struct.pack(">HHIHxx", 256, 3, 1, 5) + struct.pack(">HHII", 257, 4, 1, 6), "tiff", 5, 6),
}
BROKEN = {"x.png": b"not a picture", "y.jpg": b"\xff\xd8\xff\xe0", "z.jpg": b"", "w.tif": b"II*\0" + struct.pack("<I", 8) + b"\0\0"}


@pytest.fixture
def folder(tmp_path):
    for name, raw in {**{k: v[0] for k, v in FILES.items()}, **BROKEN, ".hidden/q.png": FILES["a.png"][0], "_t.png": FILES["a.png"][0], "n.txt": b"text"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_headers_and_bytes(spark, folder):
    rows = {os.path.relpath(r.path, folder): r for r in P.encoded_pictures(spark, folder).collect()}
    assert set(rows) == set(FILES) | set(BROKEN)
    for name, (raw, kind, width, height) in FILES.items():
        r = rows[name]
        assert (r.size_bytes, r.format, r.width, r.height, r.pixels, r.error) == (len(raw), kind, width, height, width * height, None), name
        assert bytes(r.content) == raw
    for name, raw in BROKEN.items():
        assert rows[name].error and rows[name].width is None and bytes(rows[name].content) == raw
    assert all(r.content is None for r in P.encoded_pictures(spark, "file://" + folder, content=False).collect())


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_filters_give_the_same_rows(spark, folder, pushed):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        df = P.encoded_pictures(spark, folder)
        got = {os.path.relpath(r.path, folder) for r in df.where("width >= 30 AND height < 50 AND size_bytes < 100000").collect()}
        assert got == {"a.png", "g.webp"}
        assert df.where("format IN ('gif', 'bmp') AND pixels <= 63").count() == 1
        assert df.where("error IS NOT NULL").count() == len(BROKEN)
        assert df.where("width IS NULL").count() == len(BROKEN)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Counted:
    """A file system that counts the bytes read."""

    def __init__(self):
        self.inner, self.read_bytes, self.opened = pyarrow.fs.LocalFileSystem(), {}, set()

    def get_file_info(self, what):
        return self.inner.get_file_info(what)

    def open_input_file(self, name):
        outer, f = self, self.inner.open_input_file(name)
        self.opened.add(os.path.basename(name))

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

            def seek(self, at):
                f.seek(at)

            def read(self, n=None):
                raw = f.read(n)
                outer.read_bytes[os.path.basename(name)] = outer.read_bytes.get(os.path.basename(name), 0) + len(raw)
                return raw
        return File()


def test_refused_files_are_not_read(folder, monkeypatch):
    files = Counted()
    monkeypatch.setattr(P, "system_of", lambda uri: (files, uri))
    reader = P.FilteringReader(folder, True)
    other = DS.StringContains(("path",), "x")
    rest = reader.pushFilters([DS.LessThanOrEqual(("pixels",), 600), DS.LessThan(("size_bytes",), 100_000), DS.IsNotNull(("width",)), other])
    assert list(rest) == [other]
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert {os.path.basename(r["path"]) for r in rows} == {"a.png", "c.gif", "d.bmp", "f.webp", "i.tiff"}
    # too long: not opened; too many pixels: one look; taken: the header and the whole
    assert "b.JPG" not in files.opened and "e.webp" in files.opened
    assert files.read_bytes["h.tif"] <= P.LOOK and files.read_bytes["x.png"] <= P.LOOK
    assert files.read_bytes["c.gif"] <= len(FILES["c.gif"][0]) + P.LOOK
    # a header behind a long comment takes a few looks
    files.read_bytes.clear()
    big = P.PictureReader(folder, False)
    assert [b for part in big.partitions() for b in big.read(part)]
    assert files.read_bytes["b.JPG"] <= 5 * P.LOOK


def test_files_are_dealt_by_size(folder, monkeypatch):
    monkeypatch.setattr(P, "TASK_BYTES", 2000)
    parts = P.PictureReader(folder, True).partitions()
    assert len(parts) > 3 and sum(len(p.files) for p in parts) == len(FILES) + len(BROKEN)


def test_empty_folder(spark, tmp_path):
    assert P.encoded_pictures(spark, str(tmp_path)).count() == 0
