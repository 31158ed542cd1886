"""Substring dedup by recompression: equal word runs get equal names, shared names reveal long repeats.

Every text is parsed in rounds. The first names maximal runs of one word, each later round names pairs: a
coin that belongs to the symbol sorts symbols into left and right ones, and a left symbol before a
right one becomes one symbol. Names are 64-bit hashes of what they stand for, so they hold across the
whole cluster without a dictionary, and equal word sequences get equal symbols but near their ends.
For each window of 35 words the rounds also tell which symbols depend on that window alone: at either end
the first run, then each symbol whose partner could lie outside, is taken off. Of the symbols left in the
highest round with any, the longest (then the smallest hash, then the leftmost) is the window's anchor.
Equal windows therefore have the same anchor at the same place, and neighbouring windows mostly share one.

Spark groups anchors by name; equal ones of a batch are counted before the shuffle, so a hot passage sends one
row per batch. A name seen once ends there. Anchors with equal name and equal text under all their windows verify each other at once. What is left (a shared name in differing surroundings, that is
the ends of repeats) is opened into single windows, which are compared by name and a second 64-bit hash.
So a word is removed by 128 bits of agreement over its window, and every repeated window is found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verigauge.llm import words as W
from verigauge.llm.store import kept

WINDOW = 35
ROUNDS = 5
#: No symbol stands for more words than this, so long runs of a word stay open to windows inside them.
LONGEST = 16

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _smallest(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the first smallest key in each non-empty range."""
    width = hi - lo
    out = np.empty(len(lo), np.int64)
    table = np.arange(len(keys))
    step, top = 1, int(width.max(initial=1))
    while step <= top:
        mine = np.flatnonzero((width >= step) & (width < 2 * step))
        if len(mine):
            x, y = table[lo[mine]], table[hi[mine] - step]
            out[mine] = np.where(keys[y] < keys[x], y, x)
        if 2 * step <= top:
            x, y = table[:-step], table[step:]
            table = np.where(keys[y] < keys[x], y, x)
        step *= 2
    return out


def anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """For every window inside one text: (its first word, anchor name, first word of the anchor)."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    p = np.arange(max(0, n - window + 1))
    p = p[text[p] == text[p + window - 1]] if len(p) else p
    name, place = np.empty(len(p), np.uint64), np.empty(len(p), np.int64)
    if not len(p):
        return p, name, place
    sym, start, length = words, np.arange(n), np.ones(n, np.int64)
    who, lo, hi = np.arange(len(p)), p.copy(), p + window

    def settle(mine, a, b):
        """Choose the anchors of windows ``mine`` among symbols a to b of this round."""
        keys = ((LONGEST - length).astype(np.uint64) << np.uint64(56)) | (W.mix(sym) >> np.uint64(8))
        at = _smallest(keys, a, b)
        name[mine], place[mine] = sym[at], start[at]

    for r in range(rounds + 1):
        m = len(sym)
        same = np.zeros(m + 1, bool)
        same[1:m] = text[1:] == text[:-1]
        if r == 0:
            head = np.ones(m + 1, bool)
            head[1:m] = ~(same[1:m] & (sym[1:] == sym[:-1]))
            begin = np.flatnonzero(head)
            run = np.searchsorted(begin, np.arange(m), "right") - 1
            new_lo, new_hi = begin[run[lo] + 1], begin[run[hi - 1]]
            size = np.diff(begin)
            joined = (size > 1) & (size <= LONGEST)
            head[:m] |= ~joined[run]
            at = np.flatnonzero(head[:m])
            grown = np.where(joined[run[at]], size[run[at]], 1)
            fresh = np.where(grown > 1, W.mix(sym[at] * _A + grown.astype(np.uint64)), sym[at])
        else:
            left = (W.mix(sym ^ W.mix(np.full(1, r, np.uint64))) >> np.uint64(17)) & np.uint64(1) == 1
            new_lo, new_hi = lo + ~left[lo], hi - left[hi - 1]
            pair = np.zeros(m + 1, bool)
            pair[1:m] = same[1:m] & left[:-1] & ~left[1:] & (length[1:] + length[:-1] <= LONGEST)
            head = ~pair
            at = np.flatnonzero(head[:m])
            two = pair[at + 1]
            fresh, grown = sym[at], length[at]
            twos = at[two]
            fresh = fresh.copy()
            fresh[two] = W.mix(sym[twos] * _A + W.mix(sym[twos + 1]) * _B)
            grown = grown.copy()
            grown[two] += length[twos + 1]
        ended = new_lo >= new_hi
        if ended.any():
            settle(who[ended], lo[ended], hi[ended])
        to = np.cumsum(head) - 1
        stay = ~ended
        who, lo, hi = who[stay], to[new_lo[stay]], to[new_hi[stay]]
        sym, start, length, text = fresh, start[at], grown, text[at]
        if not len(who):
            break
    if len(who):
        settle(who, lo, hi)
    return p, name, place


def _parsed(column: pa.Array):
    """(first row, first words, word hashes) of each slice of a text column."""
    for lo, hi, data, offsets in W.slices(W.strings(column)):
        starts, ends, first = W.spans(data, offsets)
        yield lo, first, W.hashes(data, starts, ends)


def _anchor_batches(window: int):
    """Anchors of a batch. Equal ones with equal surroundings prove each other: one goes on with their number."""
    def run(batches):
        for batch in batches:
            dk, tag = batch.column("dk").to_numpy(), batch.column("tag").to_numpy()
            parts: list[list[np.ndarray]] = []
            for row, first, words in _parsed(batch.column("text")):
                p, name, place = anchors(words, first, window)
                if not len(p):
                    continue
                fresh = np.ones(len(p), bool)
                fresh[1:] = (place[1:] != place[:-1]) | (p[1:] != p[:-1] + 1) | (name[1:] != name[:-1])
                at = np.flatnonzero(fresh)
                lo, last = p[at], p[np.append(at[1:], len(p)) - 1]
                whole = W.range_hashes(W.prefix_sums(words), lo, last + window)
                whole = W.mix(whole + (place[at] - lo).astype(np.uint64) * _B)
                doc = np.searchsorted(first, lo, "right") - 1
                parts.append([name[at], whole, dk[row + doc], tag[row + doc],
                              (lo - first[doc]).astype(np.int32), (last - lo + 1).astype(np.int32)])
            if not parts:
                continue
            name, whole, dk, tag, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((whole, name))
            fresh = np.ones(len(order), bool)
            fresh[1:] = ((name[order][1:] != name[order][:-1]) | (whole[order][1:] != whole[order][:-1]))
            at = np.flatnonzero(fresh)
            count = np.zeros(len(order), np.int32)
            count[order[at]] = np.diff(np.append(at, len(order)))
            proved = count == 0
            name[proved] = W.mix(dk[proved].view(np.uint64) + lo[proved].astype(np.uint64) * _A)
            yield pa.RecordBatch.from_arrays(
                [pa.array(W.as_signed(name)), pa.array(W.as_signed(whole)), pa.array(dk), pa.array(tag),
                 pa.array(lo), pa.array(n), pa.array(count)],
                ["name", "whole", "dk", "tag", "lo", "n", "c"])
    return run


def _window_batches(window: int):
    """Opens the listed anchors of each text into single windows."""
    def run(batches):
        for batch in batches:
            dk, tag = batch.column("dk").to_numpy(), batch.column("tag").to_numpy()
            lists = batch.column("opened")
            for row, first, words in _parsed(batch.column("text")):
                part = lists.slice(row, len(first) - 1)
                flat = part.flatten()
                doc = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                lo, n, name, single = (flat.field(k).to_numpy(zero_copy_only=False)
                                       for k in ("lo", "n", "name", "single"))
                each = np.repeat(np.arange(len(lo)), n)
                p = lo[each] + (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
                at = first[doc[each]] + p
                mark = W.range_hashes(W.prefix_sums(words), at, at + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[each]), pa.array(W.as_signed(mark)), pa.array(dk[row + doc[each]]),
                     pa.array(tag[row + doc[each]]), pa.array(p.astype(np.int32)), pa.array(single[each])],
                    ["name", "mark", "dk", "tag", "p", "single"])
    return run


def _kept_batches(batches):
    """Takes the covered words out of each text."""
    for batch in batches:
        column = W.strings(batch.column("text"))
        lists = batch.column("cover")
        total = np.zeros(batch.num_rows, np.int64)
        gone = np.zeros(batch.num_rows, np.int64)
        texts: list[bytes] = []
        for row, _, data, offsets in W.slices(column):
            starts, ends, first = W.spans(data, offsets)
            part = lists.slice(row, len(first) - 1)
            flat = part.flatten()
            doc = np.repeat(np.arange(len(part)), [k or 0 for k in part.value_lengths().to_pylist()])
            step = np.zeros(len(starts) + 1, np.int64)
            if len(flat):
                lo, hi = (flat.field(k).to_numpy() for k in ("lo", "hi"))
                np.add.at(step, first[doc] + lo, 1)
                np.add.at(step, first[doc] + hi, -1)
            keep = np.cumsum(step)[:-1] == 0
            # kept words, each with one blank behind it
            size = np.where(keep, ends - starts + 1, 0)
            to = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(size, out=to[1:])
            wide = np.flatnonzero(keep)
            out = np.full(to[-1], 0x20, np.uint8)
            body = size[wide] - 1
            inner = np.arange(int(body.sum())) - np.repeat(np.cumsum(body) - body, body)
            out[np.repeat(to[wide], body) + inner] = data[np.repeat(starts[wide], body) + inner]
            blob = out.tobytes()
            a, b = to[first[:-1]], to[first[1:]]
            texts += [blob[x:max(x, y - 1)] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            total[row:row + len(first) - 1] = np.diff(first)
            kept_before = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(keep, out=kept_before[1:])
            gone[row:row + len(first) - 1] = np.diff(first) - np.diff(kept_before[first])
        yield pa.RecordBatch.from_arrays(
            [*[c for c, f in zip(batch.columns, batch.schema.names, strict=True)
               if f not in ("text", "cover")],
             pa.array(total), pa.array(gone), pa.array([t.decode() for t in texts], pa.string()),
             pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
            [*[f for f in batch.schema.names if f not in ("text", "cover")],
             "n_words", "n_removed", "kept_text", "kept_sha256"])


def _hash_batches(batches):
    for batch in _kept_batches(batches):
        yield batch.drop_columns(["kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, [kept_text,] kept_sha256): each text without its repeated passages.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if any window of ``window`` words over it also
    starts anywhere else in the table, in the same text or another; windows are judged on the input.
    Kept words are joined by one space. A null text has no words; texts shorter than the window
    stay whole; repeated rows empty each other if they are long enough; ids may be null or repeated. An
    empty table gives no rows; other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows that share both numbers have equal ids and texts, hence equal results
    keyed = base.select("id", F.xxhash64("id", "text").alias("dk"), F.hash("text", "id").alias("tag"), "text")
    found = keyed.select("dk", "tag", "text").mapInArrow(
        _anchor_batches(window), "name long, whole long, dk long, tag int, lo int, n int, c int")
    proved = F.col("c") == 0
    alike, named = Window.partitionBy("name", "whole"), Window.partitionBy("name")
    near = (found.withColumn("first", F.row_number().over(alike.orderBy("dk", "tag", "lo")) == 1)
            .withColumn("copies", F.sum("c").over(alike))
            .withColumn("several", F.min("whole").over(named) < F.max("whole").over(named))
            .select("name", "dk", "tag", "lo", "n", (proved | (F.col("copies") > 1)).alias("covered"),
                    (~proved & F.col("several") & (F.col("first") | (F.col("copies") == 1))).alias("open"),
                    (F.col("copies") == 1).alias("single")))
    near = kept(near.where("covered OR open"))
    cover = near.where("covered").select("dk", "tag", "lo", (F.col("lo") + F.col("n") + (window - 1)).alias("hi"))
    opened = near.where("open").groupBy("dk", "tag").agg(
        F.collect_set(F.struct("lo", "n", "name", "single")).alias("opened"))
    # sets: rows that are equal in id and text bring the same passages, each once
    # both this join and the last one take the texts by the same exchange, which Spark fills once
    single = keyed.join(opened, ["dk", "tag"]).mapInArrow(
        _window_batches(window), "name long, mark long, dk long, tag int, p int, single boolean")
    again = single.groupBy("name", "mark").agg(F.count("*").alias("c"), F.max("single").alias("any")).where("c > 1 AND any")
    hits = (single.where("single").join(again.select("name", "mark"), ["name", "mark"])
            .select("dk", "tag", F.col("p").alias("lo"), (F.col("p") + window).alias("hi")))
    covers = (cover.unionByName(hits).groupBy("dk", "tag")
              .agg(F.collect_set(F.struct("lo", "hi")).alias("cover")))
    kind = base.schema["id"].dataType.simpleString()
    text = "kept_text string, " if with_text else ""
    return (keyed.join(covers, ["dk", "tag"], "left").select("id", "text", "cover")
            .mapInArrow(_kept_batches if with_text else _hash_batches,
                        f"id {kind}, n_words long, n_removed long, {text}kept_sha256 string")
            .withColumnRenamed("id", id_col))
