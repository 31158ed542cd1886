"""WARC archives: a writer and a Python data source that skips what a query does not need.

The writer makes one file per task, a record per row, each record a gzip member of its own. The member's header has the
``sl`` extra field (compressed and full length), so a reader can step over a record without inflating it. A payload seen
before becomes a revisit record that refers to the record with the smallest id.

The source plans small files together and large ones alone. It inflates the start of a record, parses its header
lines and applies the filters that Spark pushes down (equality and lists on record type and other header
columns); only records that pass are inflated further, and only if the schema asks for the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition)
from pyspark.sql.types import StructType

from verigauge.llm.store import fresh, kept, opened, put

DATE = "1970-01-01T00:00:00Z"
#: Bytes of small files that one task reads.
TASK_BYTES = 64 << 20
_HEAD = 1 << 12
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Columns of the source and the header lines they come from. The last two lines are this writer's own.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to_id": "WARC-Refers-To", "content_type": "Content-Type",
    "content_length": "Content-Length", "row_id": "X-Row-ID", "refers_to_row": "X-Refers-To-Row-ID", "payload_length": "X-Payload-Length"}
_LONGS = {"content_length", "row_id", "refers_to_row", "payload_length"}
SCHEMA = ", ".join(f"{c} {'long' if c in _LONGS else 'string'}" for c in HEADERS) + ", payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: int | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{salt}/{row}')}>"


def member(raw: bytes) -> bytes:
    """One gzip member with skip lengths."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(raw) + press.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    if max(size, len(raw)) >= 1 << 32:  # too long for the field: readers inflate it
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw)) + body + tail)


def record(lines: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    return text.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    """Control characters would end the header line."""
    return None if url is None else "".join(c if c.isprintable() else "%%%02X" % ord(c) if ord(c) < 256 else "%3F" for c in url)


def _write_batches(folder: str):
    def run(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        count = 0

        def members() -> Iterator[bytes]:
            nonlocal count
            yield member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(part, "file")), ("WARC-Date", DATE),
                                 ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for batch in batches:
                for row in batch.to_pylist():
                    payload = row["payload"] or b""
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
                    revisit = row["again"]
                    own = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row["id"], own + ("/again" if revisit else ""))),
                             ("WARC-Target-URI", _uri(row["url"])), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{own}"),
                             ("WARC-Profile", _PROFILE if revisit else None),
                             ("WARC-Refers-To", record_id(row["first"], own) if revisit else None),
                             ("Content-Type", "application/http; msgtype=response"), ("X-Row-ID", row["id"]),
                             ("X-Refers-To-Row-ID", row["first"] if revisit else None), ("X-Payload-Length", row["size"])]
                    yield member(record(lines, http if revisit else http + payload))
                    count += 1
        put(f"{folder}/part-{part:06d}.warc.gz", members())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([count], pa.int64())], ["part", "records"])
    return run


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", least_bytes: int = 0) -> tuple[str, int]:
    """(folder, records written): a record per row, payload the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the smallest id are responses, the
    others revisit them; smaller payloads are all responses. Null ids count as larger than all; where only null ids share a
    payload, all are responses. A null url has no header line. An empty table writes no record; other columns are not looked at.
    """
    folder = folder or fresh(pages.sparkSession, "warc")
    rows = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
            .withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload")}))
    same = (rows.select("sha1", "size", "id").groupBy("sha1", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
            .where((F.col("n") > 1) & (F.col("size") >= least_bytes)).drop("n"))
    marked = (rows.join(same, ["sha1", "size"], "left")
              .withColumn("again", F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False)))
              .select("id", "url", "sha1", "size", "first", "again", F.when(~F.col("again"), F.col("payload")).alias("payload")))
    done = kept(marked.mapInArrow(_write_batches(folder), "part int, records long"))
    return folder, done.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


def _fields(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def members(f, size: int) -> Iterator[tuple[dict[str, str], object]]:
    """(header fields, function that gives the block) of each record of an open file, plain or gzip."""
    at = 0
    while at < size:
        f.seek(at)
        start = f.read(_HEAD)
        if start[:2] != b"\x1f\x8b":
            while (end := start.find(b"\r\n\r\n")) < 0 and at + len(start) < size:
                start += f.read(_HEAD)
            fields = _fields(start[:end])
            body, length = at + end + 4, int(fields.get("content-length", 0))

            def block(body=body, length=length):
                f.seek(body)
                return f.read(length)
            yield fields, block
            at = body + length + 4
            continue
        skip, head = 0, 10
        if start[3] & 4:
            extra = struct.unpack_from("<H", start, 10)[0]
            if start[12:14] == b"sl":
                skip = struct.unpack_from("<I", start, 16)[0]
            head = 12 + extra
        state = {"engine": zlib.decompressobj(-15), "next": at + len(start), "raw": b"", "left": start[head:]}

        def more(state=state) -> bool:
            """Inflate another piece; False at the end of the member."""
            if state["engine"].eof:
                return False
            if not state["left"]:
                f.seek(state["next"])
                state["left"] = f.read(1 << 16)
                state["next"] += len(state["left"])
                if not state["left"]:
                    raise ValueError("a record ends too early")
            state["raw"] += state["engine"].decompress(state["left"])
            state["left"] = b""
            return True
        while b"\r\n\r\n" not in state["raw"] and more():
            pass
        end = state["raw"].find(b"\r\n\r\n")
        fields = _fields(state["raw"][:end])

        def block(state=state, more=more, end=end, fields=fields):
            parts = [state["raw"]]
            while not state["engine"].eof:
                state["raw"] = b""
                more()
                parts.append(state["raw"])
            state["raw"] = b"".join(parts)
            return state["raw"][end + 4:end + 4 + int(fields.get("content-length", 0))]
        yield fields, block
        if not skip:
            while more():
                state["raw"] = state["raw"][:0] if state["engine"].eof else b""
            skip = state["next"] - len(state["engine"].unused_data) + 8 - at
        at += skip


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(0)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = {f.value} if isinstance(f, (EqualTo, EqualNullSafe)) else set(f.value) if isinstance(f, In) else {None}
            name = f.attribute[0] if None not in values and len(f.attribute) == 1 else ""
            if name in HEADERS:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        found = []
        for path in self.path.split(","):
            system, place = opened(path)
            info = system.get_file_info(place)
            infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
            root = path if system.type_name != "local" else "file:///" + place.lstrip("/")
            found += [(root.rstrip("/") + i.path[len(place.rstrip("/")):], i.size) for i in infos
                      if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        tasks, size = [[]], 0
        for path, n in sorted(found):
            if tasks[-1] and size + n > TASK_BYTES:
                tasks, size = [*tasks, []], 0
            tasks[-1].append(path)
            size += n
        return [_Files(t) for t in tasks]

    def read(self, partition: _Files):
        for path in partition.files:
            system, place = opened(path)
            size = system.get_file_info(place).size
            with system.open_input_file(place) as f:
                for fields, block in members(f, size):
                    row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
                    row |= {c: int(row[c]) if row[c] is not None else None for c in _LONGS}
                    if any(row[c] not in v for c, v in self.wanted.items()):
                        continue
                    row["payload"] = self._payload(row, block) if "payload" in self.columns else None
                    yield tuple(row[c] for c in self.columns)

    @staticmethod
    def _payload(row: dict, block) -> bytes | None:
        """The payload of a response, checked against its digest; of other records their block."""
        if row["record_type"] == "revisit":
            return None
        raw = block()
        if not (row["content_type"] or "").startswith("application/http"):
            return raw
        payload = raw[raw.find(b"\r\n\r\n") + 4:]
        if (row["payload_digest"] or "").startswith("sha1:") and row["payload_digest"][5:] != digest(payload):
            raise ValueError(f"payload of {row['record_id']} does not match its digest")
        return payload


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``: records of ``.warc`` and ``.warc.gz`` files below a path."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        unknown = set(schema.names) - {*HEADERS, "payload"}
        if unknown:
            raise ValueError(f"no such columns in a WARC record: {sorted(unknown)}")
        return WarcReader(self.options["path"], schema.names)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records below ``path``; leave ``payload`` out of ``schema`` to read headers only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").schema(schema).load(path)
