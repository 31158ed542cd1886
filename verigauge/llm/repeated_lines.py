"""Line dedup: hashes of lines in ranges, a secondary sort by document and position, bitmaps of kept lines.

Every long line becomes (128-bit hash of its key, document, position). Rows are dealt by range of all three, so the
rows of one very common line span many partitions, and sorted, the largest document first. Every partition
is streamed: the first document of a key keeps its lines, those of all later ones go once enough documents
have been seen; only the lines of the first few documents of the key at hand are held back. A key that goes on over the edge
of a partition is left open there with a summary (documents, first and last of them). The summaries, two a partition
at most, settle what is open. Dropped positions leave as a compressed bitmap per document, not as text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigauge.llm import words as W
from verigauge.llm.store import kept, shared

#: The blanks x20 and x09 to x0D, and the letters A to Z.
BLANKS = " \t\n\x0b\x0c\r"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_CHARS = 40
LEAST_DOCS = 5


def pack(dropped: np.ndarray) -> bytes:
    """A compressed bitmap of kept lines; lines past its end are kept."""
    bits = np.ones((int(dropped.max()) // 8 + 1) * 8, bool)
    bits[dropped] = False
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each line is kept."""
    out = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)[:n_lines]
        out[:len(bits)] = bits
    return out


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(key, doc, tag, at) of the long lines of (doc, tag, text)."""
    rows = docs.select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    key = F.translate(F.trim("line", F.lit(BLANKS)), LETTERS, LETTERS.lower())
    return (rows.select("doc", "tag", "at", key.alias("key")).where(F.char_length("key") >= least_chars)
            .select(F.unhex(F.md5("key")).alias("key"), "doc", "tag", "at"))


_FOUND = "doc long, tag long, at int, open binary, n_docs long, first long, last long, part int"


class _Stream:
    """The sorted rows of a partition, batch by batch."""

    def __init__(self, part: int, least: int):
        self.part, self.least = part, least
        self.key: bytes | None = None
        self.leading = True
        self.held: list = []

    def _rows(self, rows: np.ndarray, open_key: bytes | None) -> None:
        if len(rows):
            self.out.append((rows, open_key))

    def _finish(self, trailing: bool) -> None:
        """The key at hand has no more rows in this partition."""
        if self.key is not None and (self.leading or trailing):
            self._hold_open(trailing)
            self.edges.append((self.key, self.n_docs, self.first, self.last))
        self.held = []

    def _hold_open(self, trailing: bool) -> None:
        if not self.leading and trailing and self.n_docs < self.least:
            for rows, _ in self.held:
                self._rows(rows, self.key)

    def take(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        self.out, self.edges = [], []
        n = batch.num_rows
        raw = batch.column("key")
        at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + n + 1]
        keys = np.frombuffer(raw.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(n, 16)
        none = np.asarray(batch.column("doc").is_null())
        doc = np.asarray(batch.column("doc").fill_null(0))
        table = np.rec.fromarrays([doc, none, np.asarray(batch.column("tag")), np.asarray(batch.column("at"))], names="doc,none,tag,at")
        fresh = np.ones(n, bool)
        fresh[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        starts = np.flatnonzero(fresh)
        new_doc = fresh.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (none[1:] != none[:-1])
        self._run(keys[0].tobytes(), table[:starts[1] if len(starts) > 1 else n], new_doc[:starts[1] if len(starts) > 1 else n])
        if len(starts) > 1:
            lo, hi = int(starts[1]), int(starts[-1])
            if hi > lo:
                self._whole(table[lo:hi], fresh[lo:hi], new_doc[lo:hi])
            self._run(keys[hi].tobytes(), table[hi:], new_doc[hi:])
        return self._batch()

    def _whole(self, rows: np.recarray, fresh: np.ndarray, new_doc: np.ndarray) -> None:
        """Rows of keys that begin and end inside a batch."""
        run = np.cumsum(fresh) - 1
        docs = np.bincount(run, new_doc).astype(np.int64)
        first = np.cumsum(docs) - docs
        rank = np.cumsum(new_doc) - first[run]
        self._rows(rows[(docs[run] >= self.least) & (rank > 1)], None)

    def _run(self, key: bytes, rows: np.recarray, new_doc: np.ndarray) -> None:
        who = (None if rows.none[0] else int(rows.doc[0]))
        new_doc = new_doc.copy()
        if key != self.key:
            if self.key is not None:
                self._finish(False)
                self.leading = False
            self.key, self.n_docs, self.first, self.last, self.held = key, 0, who, None, []
            new_doc[0] = True
        else:
            new_doc[0] = who != self.last
        rank = self.n_docs + np.cumsum(new_doc)
        self.n_docs = int(rank[-1])
        self.last = None if rows.none[-1] else int(rows.doc[-1])
        if self.leading:
            self._rows(rows, key)
        elif self.n_docs >= self.least:
            for held, its in self.held:
                self._rows(held[its > 1], None)
            self.held = []
            self._rows(rows[rank > 1], None)
        else:
            self.held.append((rows.copy(), rank))

    def end(self) -> pa.RecordBatch | None:
        self.out, self.edges = [], []
        self._finish(True)
        return self._batch()

    def _batch(self) -> pa.RecordBatch | None:
        if not self.out and not self.edges:
            return None
        k = len(self.edges)
        doc = np.concatenate([r.doc for r, _ in self.out] + [np.zeros(k, np.int64)])
        none = np.concatenate([r.none for r, _ in self.out] + [np.ones(k, bool)])
        pad = len(doc) - k
        keys = [x for r, key in self.out for x in [key] * len(r)] + [e[0] for e in self.edges]
        tag = np.concatenate([r.tag for r, _ in self.out] + [np.zeros(k, np.int64)])
        at = np.concatenate([r.at for r, _ in self.out] + [np.full(k, -1, np.int32)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, mask=none), pa.array(tag), pa.array(at), pa.array(keys, pa.binary()),
             *[pa.array([None] * pad + [e[i] for e in self.edges], pa.int64()) for i in (1, 2, 3)],
             pa.array([None] * pad + [self.part] * k, pa.int32())],
            ["doc", "tag", "at", "open", "n_docs", "first", "last", "part"])


def _decide(least: int):
    def run(batches):
        state = _Stream(TaskContext.get().partitionId(), least)
        for batch in batches:
            if batch.num_rows:
                out = state.take(batch)
                if out is not None:
                    yield out
        out = state.end()
        if out is not None:
            yield out
    return run


def _dropped(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(doc, tag, at) of every line to drop."""
    by = [F.col("key").asc(), F.col("doc").desc_nulls_last(), F.col("tag").asc(), F.col("at").asc(), F.col("source").asc()]
    # stored, as finding the ranges reads the lines a second time
    lines = kept(_lines(docs, least_chars))
    dealt = lines.withColumn("source", F.spark_partition_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    found = kept(dealt.select("key", "doc", "tag", "at").mapInArrow(_decide(least_docs), _FOUND))
    order = Window.partitionBy("open").orderBy("part")
    edges = found.where("at < 0").withColumn("again", (F.lag("part").over(order).isNotNull() & F.lag("last").over(order).eqNullSafe(F.col("first"))).cast("long"))
    # the largest document is the first one of the first partition; two rows a partition at most
    keys = edges.groupBy("open").agg(F.sum(F.col("n_docs") - F.col("again")).alias("docs"), F.min(F.struct("part", "first")).alias("head"))
    keys = F.broadcast(keys.where(F.col("docs") >= least_docs).select("open", F.col("head.first").alias("largest")))
    rest = found.where("at >= 0 AND open IS NOT NULL").join(keys, "open").where(~F.col("doc").eqNullSafe(F.col("largest")))
    return found.where("at >= 0 AND open IS NULL").select("doc", "tag", "at").unionByName(rest.select("doc", "tag", "at"))


def _pack_batches(batches):
    for batch in batches:
        at = batch.column("dropped")
        maps, counts = [], []
        for k in range(batch.num_rows):
            these = np.asarray(at[k].values)
            maps.append(pack(these))
            counts.append(len(these))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())],
                                         ["doc", "tag", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                 least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, tag, n_dropped, keep) for every document that loses lines: ``tag`` is the 64-bit hash of the text, ``keep`` a
    compressed bitmap (:func:`unpack`).

    A line's key is the line without blanks at both ends, A-Z in lower case. A key of at least ``least_chars`` code
    points in at least ``least_docs`` documents loses all its lines but those of the largest id that has
    it. Rows that share an id are one document for that count, each with its own bitmap; a null id is one
    document, smaller than all others. Null and empty texts are one empty line. An empty table
    gives no rows; other columns are not looked at.
    """
    shared(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), _tag(text_col).alias("tag"), F.col(f"`{text_col}`").cast("string").alias("text"))
    places = _dropped(slim, least_chars, least_docs).groupBy("doc", "tag").agg(F.collect_set("at").alias("dropped"))
    return places.mapInArrow(_pack_batches, "doc long, tag long, n_dropped long, keep binary")


def _tag(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string"))


def _apply_batches(text_at: str, keep_at: str, with_text: bool):
    def run(batches):
        for batch in batches:
            column = W.strings(batch.column(text_at))
            keeps = batch.column(keep_at)
            n_lines, n_dropped, sums, rest = [], [], [], []
            for k in range(batch.num_rows):
                text = column[k].as_buffer().to_pybytes()
                keep = keeps[k].as_py()
                lines, gone = text.count(b"\n") + 1, 0
                if keep is not None:
                    stay = unpack(keep, lines)
                    gone = lines - int(stay.sum())
                    text = b"\n".join([line for line, s in zip(text.split(b"\n"), stay.tolist(), strict=True) if s])
                n_lines.append(lines)
                n_dropped.append(gone)
                sums.append(hashlib.sha256(text).hexdigest())
                rest.append(text)
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sums, pa.string())]
            names = ["n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                made.append(pa.array(rest, pa.large_binary()).cast(pa.large_string()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], ["doc_id", *names])
    return run


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS,
                           least_docs: int = LEAST_DOCS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept_text) for every row of ``docs``, by the bitmaps of :func:`keep_bitmaps`.

    Other lines stay as they are, joined by newlines; a text that loses all its lines becomes empty.
    """
    maps = keep_bitmaps(docs, id_col, text_col, least_chars, least_docs)
    maps = kept(maps).select(F.col("doc").alias("map_doc"), F.col("tag").alias("map_tag"), "keep")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), _tag(text_col).alias("tag"), F.col(f"`{text_col}`").cast("string").alias("text"))
    both = slim.join(maps, F.col("doc").eqNullSafe(F.col("map_doc")) & (F.col("tag") == F.col("map_tag")), "left").select("doc", "text", "keep")
    kind = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return both.mapInArrow(_apply_batches("text", "keep", with_text), kind)
