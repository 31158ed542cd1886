"""One file from many tasks, committed once.

Rows are made into text by Spark's own functions. Every task writes its lines to a part of its own; what reaches the driver
from a task is the part's name and size. The commit appends the parts, in the order of the partitions and a few megabytes at
a time, to a draft that takes the file's name when it is whole. A failed job leaves neither parts nor draft, and an
earlier file stays as it was.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F

from verigauge.session import ship_package
from verigauge.sources.pictures import system_of

#: Text that is written or appended at once.
CHUNK = 4 << 20


@dataclass
class Part(DS.WriterCommitMessage):
    number: int
    path: str
    rows: int
    size: int


class OneFileWriter(DS.DataSourceWriter):
    def __init__(self, path: str, before: str, between: str, after: str):
        self.path, self.before, self.between, self.after = path, before.encode(), between.encode(), after.encode()
        # hidden from readers of the folder
        self.drafts = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}-{uuid.uuid4().hex}"

    def write(self, rows) -> Part:
        """Lines of a partition, kept apart by ``between``; each attempt has a part of its own."""
        system, folder = system_of(self.drafts)
        system.create_dir(folder, recursive=True)
        number = TaskContext.get().partitionId()
        path = f"{folder}/{number:06d}-{uuid.uuid4().hex}"
        n = size = 0
        with system.open_output_stream(path, compression=None) as out:
            held: list[bytes] = []
            for row in rows:
                held.append(self.between * (n > 0) + row[0].encode())
                n, size = n + 1, size + len(held[-1])
                if len(held) >= 10_000 or len(held[-1]) > CHUNK:
                    out.write(b"".join(held))
                    held = []
            out.write(b"".join(held))
        return Part(number, path, n, size)

    def commit(self, messages) -> None:
        system, path = system_of(self.path)
        _, folder = system_of(self.drafts)
        system.create_dir(folder, recursive=True)
        draft, first = f"{folder}/whole", True
        with system.open_output_stream(draft, compression=None) as out:
            out.write(self.before)
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                out.write(b"" if first else self.between)
                first, left = False, part.size
                with system.open_input_stream(part.path, compression=None) as f:
                    while chunk := f.read(CHUNK):
                        left -= len(chunk)
                        out.write(chunk)
                if left:
                    raise OSError(f"{part.path} has {part.size - left} bytes instead of {part.size}")
            out.write(self.after)
        system.move(draft, path)
        system.delete_dir(folder)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, folder = system_of(self.drafts)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class OneFile(DS.DataSource):
    """``df.write.format("one_file")`` for a table with one text column; options ``before``, ``between``, ``after``."""

    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        if schema.simpleString() != "struct<value:string>":
            raise ValueError(f"one_file writes one text column named value, not {schema.simpleString()}")
        return OneFileWriter(self.options["path"], *[self.options.get(k, "") for k in ("before", "between", "after")])


def write_lines(df: DataFrame, path: str, before: str = "", between: str = "\n", after: str = "\n") -> None:
    """The text column ``value`` as one file, in the order of the table; null rows are left out."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(OneFile)
    (df.where("value IS NOT NULL").write.format("one_file").mode("overwrite").options(before=before, between=between, after=after).save(path))


def write_json_list(df: DataFrame, path: str) -> None:
    """One JSON list of all rows; nulls are written, so that a failed item still shows its verdict as null."""
    row = F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"})
    write_lines(df.select(row.alias("value")), path, "[\n", ",\n", "\n]\n")


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a header; nulls are blank."""
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n') else c for c in df.columns)
    row = F.to_csv(F.struct(*[f"`{c}`" for c in df.columns]), {"emptyValue": "", "escape": '"'})
    write_lines(df.select(row.alias("value")), path, head + "\n")
