"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits of the lower-cased text (non-ASCII characters count as letters). Every window of
five words of a benchmark item is a seed, found by its rolling hash (Karp-Rabin). Documents are looked
up in the sorted seeds; a document and an item that share seeds are tiled: of all common word runs of five words and
more, the longest that touches no marked word is marked, again and again. The item's share of marked words is its
coverage. As tiles may come in any order, a passage cut up and reordered still counts.

The benchmark is a query set: it is cut into blocks of bounded size, each a file of sorted arrays that a
task of the build writes and every scanning task reads. Documents are scanned once and never shuffled.
"""

from __future__ import annotations

import heapq
import io
import uuid
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm import words as W
from verigauge.llm.store import fresh, opened, put, release, tidy

LEAST_TILE = 5
#: Share of an item's words that a document has to cover.
COVERAGE = 0.5
#: Characters of benchmark text in one block.
BLOCK_CHARS = 8 << 20
#: Slices of text that one reading of a block serves.
SLICES = 8


def _build_batches(folder: str, least: int):
    """The items of a partition -> one block file: sorted seeds with item and place, and where the items start."""
    def run(batches):
        ids, words, sizes = [], [], []
        for batch in batches:
            for lo, hi, data, offsets in W.slices(W.strings(batch.column("text"), lower=True)):
                starts, ends, first = W.spans(data, offsets, W.MARKS)
                words.append(W.hashes(data, starts, ends))
                sizes.append(np.diff(first))
                ids += batch.column("item").slice(lo, hi - lo).to_pylist()
        if not ids:
            return
        size, words = np.concatenate(sizes), np.concatenate(words)
        first = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=first[1:])
        item = np.repeat(np.arange(len(size)), size)
        seeds = W.windows(words, least)
        at = np.arange(len(seeds))
        at = at[item[at] == item[at + least - 1]] if len(at) else at
        order = at[np.argsort(seeds[at], kind="stable")]
        # where one word repeats, equal seeds follow each other: such a run is one entry with its length
        new = np.flatnonzero(np.r_[True, (seeds[order][1:] != seeds[order][:-1]) | (order[1:] != order[:-1] + 1)
                                   | (item[order][1:] != item[order][:-1])]) if len(order) else order
        length = np.diff(np.r_[new, len(order)])
        order = order[new]
        out = io.BytesIO()
        np.savez(out, seeds=seeds[order], at=order, length=length, item=item[order].astype(np.int32), first=first,
                 ids=np.array([-1 if x is None else x for x in ids], np.int64))
        # an attempt's own name: only those reported by finished tasks are read
        path = f"{folder}/{uuid.uuid4().hex}.npz"
        put(path, [out.getvalue()])
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])
    return run


@lru_cache(maxsize=4)
def _block(path: str) -> dict[str, np.ndarray]:
    system, place = opened(path)
    with system.open_input_file(place) as f, np.load(io.BytesIO(f.read())) as z:
        return dict(z)


def common_runs(i: np.ndarray, p: np.ndarray, j: np.ndarray, q: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Longest common word runs (words, place in item, place in document) from runs of equal seeds.

    ``p`` seeds from ``i`` in the item all equal ``q`` seeds from ``j`` in the document. Such a rectangle of places is
    p + q - 1 diagonals, not p * q pairs; pieces that follow each other on a diagonal are one run.
    """
    n = p + q - 1
    each = np.repeat(np.arange(len(i)), n)
    e = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    di, dj = np.maximum(p[each] - 1 - e, 0), np.maximum(e - p[each] + 1, 0)
    size = np.minimum(p[each] - di, q[each] - dj)
    start, diagonal = i[each] + di, i[each] + di - j[each] - dj
    order = np.lexsort((start, diagonal))
    start, diagonal, size = start[order], diagonal[order], size[order]
    new = np.flatnonzero(np.r_[True, (diagonal[1:] != diagonal[:-1]) | (start[1:] != start[:-1] + size[:-1])])
    words = np.add.reduceat(size, new) + least - 1
    return list(zip(words.tolist(), start[new].tolist(), (start - diagonal)[new].tolist(), strict=True))


def tile(n_item: int, n_doc: int, common: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, words) from the longest common runs of two texts."""
    runs = [(-n, i, j) for n, i, j in common]
    heapq.heapify(runs)
    taken_i, taken_j = np.zeros(n_item, bool), np.zeros(n_doc, bool)
    tiles = []
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        marked = taken_i[i:i + n] | taken_j[j:j + n]
        if not marked.any():
            taken_i[i:i + n] = taken_j[j:j + n] = True
            tiles.append((i, j, n))
            continue
        free = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
        for a, b in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(runs, (a - b, i + a, j + a))
    return tiles


def _scan(words: np.ndarray, first: np.ndarray, block: dict[str, np.ndarray], least: int, coverage: float):
    """(text, item id, coverage, tiles) of every document of a slice and item of a block that reach the coverage."""
    seeds = block["seeds"]
    if not len(seeds):
        return
    values = W.windows(words, least)
    lo = np.searchsorted(seeds, values)
    lo[lo == len(seeds)] = 0
    hit = np.flatnonzero(seeds[lo] == values)
    text = np.searchsorted(first, hit, "right") - 1
    inside = hit + least <= first[text + 1]
    hit, text = hit[inside], text[inside]
    if not len(hit):
        return
    begin = lo[hit]
    new = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (text[1:] != text[:-1]) | (begin[1:] != begin[:-1])])
    repeat = np.diff(np.r_[new, len(hit)])
    hit, text, begin = hit[new], text[new], begin[new]
    count = np.searchsorted(seeds, values[hit], "right") - begin
    each = np.repeat(np.arange(len(hit)), count)
    k = np.repeat(begin, count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    item, place, text, at, repeat = block["item"][k].astype(np.int64), block["at"][k], text[each], hit[each], repeat[each]
    order = np.lexsort((at, place, item, text))
    item, place, text, at, repeat, k = item[order], place[order], text[order], at[order], repeat[order], k[order]
    edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]), True])
    starts = block["first"]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        x, d = int(item[a]), int(text[a])
        i0, j0 = int(starts[x]), int(first[d])
        n = int(starts[x + 1]) - i0
        length = block["length"][k[a:b]]
        reach = np.zeros(n + 1, np.int64)
        np.add.at(reach, place[a:b] - i0, 1)
        np.add.at(reach, place[a:b] - i0 + length + least - 1, -1)
        if np.count_nonzero(np.cumsum(reach)[:-1]) < coverage * n:
            continue
        common = common_runs(place[a:b] - i0, length, at[a:b] - j0, repeat[a:b], least)
        tiles = tile(n, int(first[d + 1]) - j0, common, least)
        share = sum(t[2] for t in tiles) / n
        if share >= coverage:
            yield d, int(block["ids"][x]), share, tiles


def _match_batches(paths: list[str], text_col: str, least: int, coverage: float, keep_clean: bool):
    def run(batches):
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            column = W.strings(batch.column(batch.schema.get_field_index(text_col)), lower=True)
            for some in batched(W.slices(column), SLICES):
                cut = []
                for lo, _, data, offsets in some:
                    starts, ends, first = W.spans(data, offsets, W.MARKS)
                    cut.append((lo, W.hashes(data, starts, ends), first))
                for path in paths:
                    block = _block(path)
                    for lo, words, first in cut:
                        for d, item, share, tiles in _scan(words, first, block, least, coverage):
                            found[lo + d].append({"item_id": item, "coverage": share, "tiles": [
                                {"item_word": t[0], "doc_word": t[1], "n": t[2]} for t in sorted(tiles)]})
            cut = words = first = data = offsets = starts = ends = None
            release()
            if keep_clean:
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))
                continue
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(
                pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("n", pa.int32())])))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(f, key=lambda m: m["item_id"]) for f in found], kind)], ["doc_id", "matches"])
    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, least: int) -> list[str]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    folder = fresh(benchmark.sparkSession, "tiles")
    parts = items.repartition(max(1, -(-chars // BLOCK_CHARS)), F.xxhash64("item", "text"))
    return sorted(r["path"] for r in parts.mapInArrow(tidy(_build_batches(folder, least)), "path string").collect())


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, matches) for every document: items covered to ``coverage`` or more, with their tiles.

    A null or empty text matches nothing, nor does an item of fewer than ``least`` words. Items without an id are -1.
    Repeated rows repeat; equal items all match; an empty benchmark leaves all clean. Ties go to the
    tile that comes first in the item, then in the document. Other columns are not looked at.
    """
    paths = _blocks(benchmark, item_col, item_text_col, least)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tidy(_match_batches(paths, "text", least, coverage, False)),
        f"doc_id {kind}, matches array<struct<item_id: long, coverage: double, "
        "tiles: array<struct<item_word: int, doc_word: int, n: int>>>>")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                         item_text_col: str = "text", least: int = LEAST_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns, that cover no benchmark item."""
    paths = _blocks(benchmark, item_col, item_text_col, least)
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in docs.columns)
    return docs.mapInArrow(tidy(_match_batches(paths, text_col, least, coverage, True)), kinds)
