"""Lists of JSON objects in one file, read by many tasks.

A JSON list may be one line of any length, so a reader that wants whole documents is one task. Here Spark's text source
cuts the file at closing braces, which splits it like any text file. Whether a brace stands in a string and how deep it is depends on all text before:
a first pass tells for every split, for both cases of its beginning (inside a string or not), how it ends and how its depth moves; a
row per split is enough to know where each begins. A second pass hands out whole objects. What goes
on over the edge of a split comes as fragments, two a split at most, which are put together by a small aggregation.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verigauge.session import shared_folder, ship_package

#: Objects of a batch that is handed on.
AT_ONCE = 1000

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*?"', re.DOTALL)
_OPEN_STRING = re.compile(r'"(?:[^"\\]|\\.)*\Z', re.DOTALL)
_BRACKETS = re.compile(r"[\[\]{}]")


def scan(piece: str, inside: bool) -> tuple[str, bool]:
    """The brackets outside strings, and whether the piece ends inside a string."""
    if inside:
        end = _REST_OF_STRING.match(piece)
        if end is None:
            return "", True
        piece = piece[end.end():]
    piece = _STRING.sub("", piece)
    left = _OPEN_STRING.search(piece)
    if left:
        piece = piece[:left.start()]
    return "".join(_BRACKETS.findall(piece)), left is not None


def moves(brackets: str) -> tuple[int, int]:
    """How the depth moves in all, and how low it gets on the way."""
    depth = low = 0
    for b in brackets:
        depth += 1 if b in "[{" else -1
        low = min(low, depth)
    return depth, low


def start_of_list(text: str, keys: Sequence[str]) -> tuple[int, int] | None:
    """(place behind the bracket, depth in the list) of the list of a document that begins with ``text``."""
    head = text.lstrip("﻿ \t\r\n")
    if head.startswith("["):
        return text.index("[") + 1, 1
    if not head.startswith("{"):
        return None
    depth, at, key = 0, 0, None
    for token in re.finditer(_STRING.pattern + r"|[\[\]{}:,]", text, re.DOTALL):
        mark = token.group()
        if mark[0] == '"':
            key, at = (mark[1:-1], token.end()) if depth == 1 else (key, at)
        elif mark == "[" and depth == 1 and key in keys and re.fullmatch(r"\s*:\s*", text[at:token.start()]):
            return token.end(), 2
        elif mark in "[{":
            depth += 1
        elif mark in "]}":
            depth -= 1
    return None


def objects(pieces, inside: bool, depth: int, level: int):
    """(kind, text) of a split's pieces, each of which a brace ended: ``whole`` objects, the ``end`` of an object that began
    earlier, the ``part`` of one that goes on in the next split, and the ``rest`` behind the list."""
    held: list[str] = []
    fresh, closed = depth == level and not inside, depth < level
    for piece in pieces:
        if not closed:
            brackets, inside = scan(piece, inside)
            move, low = moves(brackets)
            closed = depth + low < level
            depth += move - (0 if inside else 1)
        if closed:
            held = []
            yield "rest", piece
            continue
        held.append(piece + "}")
        if depth == level and not inside:
            yield "whole" if fresh else "end", "".join(held)
            held, fresh = [], True
    if held:
        yield "part", "".join(held)


def body(text: str) -> str | None:
    """The object at the end of a piece of list, without the elements before it that are no objects."""
    depth = 0
    for token in re.finditer(_STRING.pattern + r"|[\[\]{}]", text, re.DOTALL):
        mark = token.group()
        if mark == "{" and depth == 0:
            return text[token.start():]
        depth += mark in "[{"
        depth -= mark in "]}"
    return None


def _runs(batches):
    """((file, split), its pieces), one after the other."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True))
    for key, group in itertools.groupby(rows, key=lambda r: r[:2]):
        yield *key, (r[2] for r in group)


def _behind(pieces, skip: int):
    """The pieces behind the first ``skip`` characters of a document."""
    for piece in pieces:
        if skip > len(piece):
            skip -= len(piece) + 1
        else:
            yield piece[skip:]
            break
    yield from pieces


def _summaries(skip: int) -> Callable:
    def run(batches):
        for file, block, pieces in _runs(batches):
            now = [[False, 0, 0], [True, 0, 0]]
            for piece in pieces if block else _behind(pieces, skip):
                for state in now:
                    brackets, state[0] = scan(piece, state[0])
                    move, low = moves(brackets)
                    state[2] = min(state[2], state[1] + low)
                    state[1] += move - (0 if state[0] else 1)
            row = {"file": file, "block": block} | {f"{n}{k}": now[k][i] for k in (0, 1) for i, n in enumerate(("inside", "depth", "low"))}
            yield pa.RecordBatch.from_pylist([row], _SUMMARY_ARROW)
    return run


_SUMMARY = "file string, block long, " + ", ".join(f"inside{k} boolean, depth{k} long, low{k} long" for k in (0, 1))
_SUMMARY_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), *[(f"{n}{k}", t) for k in (0, 1) for n, t in (
    ("inside", pa.bool_()), ("depth", pa.int64()), ("low", pa.int64()))]])


def _cut(begins: dict, level: int, skip: int) -> Callable:
    def run(batches):
        for _, block, pieces in _runs(batches):
            inside, depth = begins[block]
            found = enumerate(objects(pieces if block else _behind(pieces, skip), inside, depth, level))
            while some := list(itertools.islice(found, AT_ONCE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some)), pa.array([k for k, _ in some], pa.int64()), pa.array([x[0] for _, x in some]),
                     pa.array([x[1] for _, x in some])], ["block", "seq", "kind", "text"])
    return run


def _bodies(batches):
    for batch in batches:
        texts = [body(t) for t in batch.column("text").to_pylist()]
        out = pa.RecordBatch.from_arrays([batch.column("row_no"), pa.array(texts, pa.string())], ["row_no", "text"])
        yield out.filter(pa.array([t is not None for t in texts], pa.bool_()))


def list_objects(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame | None:
    """(row_no, text) of the objects in the list of one JSON file, in the order of ``row_no``.

    The document is a list, or an object with a list under one of ``keys``; otherwise, and if another such list follows, there is
    no table. The beginning up to the list must lie in the first split. Elements that are no objects are passed over. UTF-8 only.
    """
    ship_package(spark)
    text = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # of the beginning, as much as it takes to see the list
    head, found = "", None
    for row in text.where("block = 0").select("value").limit(1000).collect():
        head += row.value + "}"
        found = start_of_list(head[:-1], keys)
        if found or len(head) > 1 << 20:
            break
    if found is None:
        return None
    skip, level = found
    splits = sorted(text.mapInArrow(_summaries(skip), _SUMMARY).collect(), key=lambda r: r.block)  # a row per split
    if len({r.file for r in splits}) > 1:
        return None
    begins, inside, depth = {}, False, level
    for r in splits:
        begins[r.block] = (inside, depth)
        k = int(inside)
        # behind the list nothing counts any more
        closed = depth < level or depth + r[f"low{k}"] < level
        inside, depth = (False, -1) if closed else (r[f"inside{k}"], depth + r[f"depth{k}"])
    cut = text.mapInArrow(_cut(begins, level, skip), "block long, seq long, kind string, text string")
    place = shared_folder(spark, "objects")
    cut.write.parquet(place)
    cut = spark.read.parquet(place)
    if keys and not cut.where("kind = 'rest'").where(F.col("text").rlike('"(' + "|".join(map(re.escape, keys)) + r')"\s*:\s*\[')).isEmpty():
        return None
    # a few rows per split: an object ends with the next end
    before = Window.orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    edge = cut.where("kind IN ('part', 'end')").withColumn("object", F.count(F.when(F.col("kind") == "end", 1)).over(before))
    pieces = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    glued = edge.groupBy("object").agg(pieces.alias("p"), F.max((F.col("kind") == "end").cast("int")).alias("ended")).where("ended = 1")
    glued = glued.select(F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join(F.col("p.text"), "").alias("text"))
    rows = cut.where("kind = 'whole'").select("block", "seq", "text").unionByName(glued)
    return rows.select((F.col("block") + F.col("seq")).alias("row_no"), "text").mapInArrow(_bodies, "row_no long, text string")


def read_objects(spark: SparkSession, path: str, keys: Sequence[str] = (), **options) -> DataFrame | None:
    """The objects of :func:`list_objects` as rows, with Spark's own JSON reader; ``row_no`` keeps their order."""
    found = list_objects(spark, path, keys)
    if found is None:
        return None
    lines = shared_folder(spark, "lines")
    # a line break cannot stand in a JSON string
    text = F.regexp_replace("text", r"[\r\n]+", " ")
    found.select(F.concat(F.lit('{"row_no": '), F.col("row_no").cast("string"), F.lit(', "record": '), text, F.lit("}")).alias("value")).write.text(lines)
    df = spark.read.options(**options).json(lines)
    if "record" not in df.columns or not df.take(1):
        return None
    return df.select("record.*", F.col("row_no").cast("long").alias("row_no"))
