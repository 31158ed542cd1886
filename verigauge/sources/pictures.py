"""Encoded pictures as a data source that looks at headers first.

A row per picture file: its format and size in pixels come from the header, a few bytes at the beginning. Filters on
``size_bytes``, ``format``, ``width``, ``height`` and ``pixels`` are settled before the file is read, so of a refused
file only the header is touched, and nothing at all if its length is enough to refuse it. Bytes are handed on as they
are: nothing is decoded here.
"""

from __future__ import annotations

import operator
import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS

from verigauge.session import ship_package

SCHEMA = ("path string, size_bytes long, format string, width int, height int, pixels long, content binary, error string")
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff")
#: Bytes that one task takes on, by the files' lengths.
TASK_BYTES = 64 << 20
#: Bytes that one look at a header reads.
LOOK = 512
#: Rows and bytes of a batch that is handed on.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Segments of a JPEG or tags of a TIFF that are looked at before a header counts as broken.
MOST_PARTS = 10_000

Look = Callable[[int, int], bytes]


def _number(look: Look, at: int, n: int, order: str = "big") -> int:
    raw = look(at, n)
    if len(raw) < n:
        raise ValueError("the header is cut off")
    return int.from_bytes(raw, order)


def _jpeg(look: Look) -> tuple[int, int]:
    at = 2
    for _ in range(MOST_PARTS):
        if _number(look, at, 1) != 0xFF:
            raise ValueError("no segment where one should begin")
        kind = _number(look, at + 1, 1)
        if kind == 0xFF:  # padding
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            return _number(look, at + 7, 2), _number(look, at + 5, 2)
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # no length follows
            at += 2
        else:
            at += 2 + _number(look, at + 2, 2)
    raise ValueError("no frame header")


def _webp(look: Look) -> tuple[int, int]:
    kind = look(12, 4)
    if kind == b"VP8X":
        return 1 + _number(look, 24, 3, "little"), 1 + _number(look, 27, 3, "little")
    if kind == b"VP8L":
        bits = _number(look, 21, 4, "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        return _number(look, 26, 2, "little") & 0x3FFF, _number(look, 28, 2, "little") & 0x3FFF
    raise ValueError("unknown chunk")


def _tiff(look: Look) -> tuple[int, int]:
    order = "little" if look(0, 2) == b"II" else "big"
    at = _number(look, 4, 4, order)
    found = {}
    for k in range(min(MOST_PARTS, _number(look, at, 2, order))):
        entry = at + 2 + 12 * k
        tag, kind = _number(look, entry, 2, order), _number(look, entry + 2, 2, order)
        if tag in (256, 257):
            found[tag] = _number(look, entry + 8, 2 if kind == 3 else 4, order)
    return found[256], found[257]


def header(look: Look) -> tuple[str, int, int]:
    """(format, width, height); ``look(at, n)`` gives bytes of the file."""
    begin = look(0, 16)
    if begin.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png", _number(look, 16, 4), _number(look, 20, 4)
    if begin.startswith(b"\xff\xd8"):
        return "jpeg", *_jpeg(look)
    if begin[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", _number(look, 6, 2, "little"), _number(look, 8, 2, "little")
    if begin.startswith(b"BM"):
        height = _number(look, 22, 4, "little")
        return "bmp", _number(look, 18, 4, "little"), height if height < 1 << 31 else (1 << 32) - height
    if begin.startswith(b"RIFF") and begin[8:12] == b"WEBP":
        return "webp", *_webp(look)
    if begin[:4] in (b"II*\0", b"MM\0*"):
        return "tiff", *_tiff(look)
    raise ValueError("no picture header")


_TESTS = {DS.EqualTo: operator.eq, DS.GreaterThan: operator.gt, DS.GreaterThanOrEqual: operator.ge, DS.LessThan: operator.lt,
          DS.LessThanOrEqual: operator.le, DS.In: lambda x, values: x in values}
_KNOWN = ("size_bytes", "format", "width", "height", "pixels")


def tests_of(filters) -> tuple[list[tuple[str, Callable, object]], list]:
    """(column, test, value) of the filters that a header can settle, and the other filters."""
    mine, rest = [], []
    for f in filters:
        column = getattr(f, "attribute", ())
        if type(f) in _TESTS and len(column) == 1 and column[0] in _KNOWN:
            mine.append((column[0], _TESTS[type(f)], f.value))
        elif isinstance(f, DS.IsNotNull) and len(column) == 1 and column[0] in _KNOWN:
            mine.append((column[0], lambda x, _: x is not None, None))
        else:
            rest.append(f)
    return mine, rest


def passes(row: dict, tests) -> bool:
    """Whether the values known so far leave the row in; a null passes no test."""
    return all(row[c] is not None and test(row[c], value) for c, test, value in tests if c in row)


class Files(DS.InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class PictureReader(DS.DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content = root, content
        self.tests: list = []

    def partitions(self) -> list[Files]:
        """Files by name and length; those that their length refuses are left out here."""
        from pyarrow import fs

        system, path = system_of(self.root)
        listed = system.get_file_info(fs.FileSelector(path, recursive=True))
        kept = sorted((f.path, f.size) for f in listed if f.type == fs.FileType.File and f.path.lower().endswith(EXTENSIONS)
                      and not hidden(f.path[len(path):]) and passes({"size_bytes": f.size}, self.tests))
        out, size = [Files([])], 0
        for name, n in kept:
            # a small file costs a task some time too
            if out[-1].files and size + n > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].files.append((name, n))
            size += n + (TASK_BYTES >> 12)
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = system_of(self.root)
        rows, size = [], 0
        for name, n in partition.files:
            row = self.row(system, name, n)
            if row is None:
                continue
            rows.append(row)
            size += len(row["content"] or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def row(self, system, name: str, n: int) -> dict | None:
        """The row of a file, or none if its header refuses it. A broken file keeps its row unless a filter asks for its size."""
        row = {"path": name, "size_bytes": n, "format": None, "width": None, "height": None, "pixels": None, "content": None, "error": None}
        with system.open_input_file(name) as f:
            held = {}

            def look(at: int, count: int) -> bytes:
                begin = held.get("at", 0)
                if not begin <= at or at + count > begin + len(held.get("raw", b"")):
                    f.seek(at)
                    held["at"], held["raw"] = at, f.read(max(count, LOOK))
                    begin = at
                return held["raw"][at - begin:at - begin + count]

            try:
                row["format"], row["width"], row["height"] = header(look)
                row["pixels"] = row["width"] * row["height"]
            except (ValueError, KeyError) as exc:
                row["error"] = f"{type(exc).__name__}: {exc}"
            if not passes(row, self.tests):
                return None
            if self.content:
                f.seek(0)
                row["content"] = f.read()
        return row


class FilteringReader(PictureReader):
    """Spark accepts a reader that takes filters only where pushing them down is switched on."""

    def pushFilters(self, filters):
        self.tests, rest = tests_of(filters)
        return rest


_ARROW = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
                    ("pixels", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def system_of(uri: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].strip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), posixpath.normpath(uri)
    return fs.FileSystem.from_uri(uri)


def hidden(path: str) -> bool:
    """Names that begin with ``_`` or ``.``, as in Spark's own listings."""
    return any(part[:1] in ("_", ".") for part in path.split("/") if part)


class PictureSource(DS.DataSource):
    """``spark.read.format("pictures").load(folder)``. Option ``content`` = false leaves the bytes out, ``filters`` = true takes filters."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PictureReader:
        kind = FilteringReader if self.options.get("filters", "false") == "true" else PictureReader
        return kind(self.options["path"], self.options.get("content", "true") != "false")


def encoded_pictures(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """``path, size_bytes, format, width, height, pixels, content, error`` of the picture files below a folder.

    Filters reach the headers where ``spark.sql.python.filterPushdown.enabled`` is set; without it they give the
    same rows after reading all files. A file without a known header keeps its row with an error.
    """
    ship_package(spark)
    spark.dataSource.register(PictureSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pictures").option("content", str(content).lower()).option("filters", pushed).load(root)
