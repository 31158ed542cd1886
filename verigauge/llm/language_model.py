"""Interpolated modified Kneser-Ney model of any order, counted in Spark, stored as sorted hash arrays.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token per text. Tasks count the
tokens of their texts; counts meet by hash bucket and each bucket is written as a file of sorted 64-bit word hashes. A
word's id is its place in these files. A second pass counts the longest grams (text starts have an id of their own), merged
inside a task, by the hash of their first two words, again as files of sorted hashes with counts. The same
tasks send on the next shorter grams with the number of different words before them, down to pairs; pairs send on, per
word, how many different words it follows and how many words follow it once, twice or more often. What follows a
longer context lies in the bucket of the context, in its order. Counts travel as packed arrays, a row per task and bucket. Scoring tasks map the
files into memory and look up sorted, distinct keys; the driver sees sums per file only.

p(w|h) = (c(hw) - D(c)) / c(h) + g(h) p(w|h'), h' being h without its first word; p(w) = (n(w) - D(n)) / n + g / (V + 1) with n(w) the number of
different words before w. c is the number of occurrences of the longest grams and of those at a text start, of all others
the number of different words before. Discounts D follow, for each length, from the numbers of grams counted 1 to 4 times.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm import words as W
from verigauge.llm.store import fresh, mapped, put

#: Characters of text for each bucket of the model.
BUCKET_CHARS = 32 << 20
#: Entries that a counting task holds at most.
HELD = 1 << 22
_END = np.uint64(0x5EED0F0E0D0C0B0A)
_STEP = np.uint64(0x9FB21C651E98DF25)
_U4, _U8 = "<u4", "<u8"

#: Fixed value of the contract: words in the longest grams of the registered query.
ORDER = 3


def _tokens(column: pa.Array):
    """(first row, token hashes with ends, first token of each text) of each slice."""
    for lo, _, data, offsets in W.slices(W.strings(column)):
        starts, ends, first = W.spans(data, offsets)
        capital = (data >= 65) & (data <= 90)
        words = W.hashes(np.where(capital, data | 32, data).astype(np.uint8), starts, ends)
        at = first + np.arange(len(first))
        out = np.full(at[-1], _END, np.uint64)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out[np.arange(len(words)) + text] = words
        yield lo, out, at


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(keys) else counts


def _counted(parts):
    """Sums of a stream of key arrays, a few at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for keys in parts:
        u, c = np.unique(keys, return_counts=True)
        held.append((u, c.astype(np.uint64)))
        size += len(u)
        if size > HELD:
            merged = _summed(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [merged], len(merged[0])
            if size > HELD // 2:
                yield merged
                held, size = [], 0
    if held:
        yield _summed(*map(np.concatenate, zip(*held, strict=True)))


def _squeeze(*columns: np.ndarray) -> bytes:
    """Number columns of one length, byte by byte, compressed."""
    n = len(columns[0])
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(n, -1).T).tobytes() for c in columns)
    return n.to_bytes(8, "little") + bytes([len(columns), *(c.itemsize for c in columns)]) + pa.compress(raw, "zstd", asbytes=True)


def _spread(blob: bytes) -> list[np.ndarray]:
    n, k = int.from_bytes(blob[:8], "little"), blob[8]
    widths = list(blob[9:9 + k])
    raw = np.frombuffer(pa.decompress(blob[9 + k:], n * sum(widths), "zstd"), np.uint8)
    at = n * np.cumsum([0, *widths])
    return [np.ascontiguousarray(raw[a:b].reshape(w, n).T).view(f"<u{w}")[:, 0] for a, b, w in zip(at, at[1:], widths)]


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(_U8 if counts.max(initial=0) >= 1 << 32 else _U4)


def _word_batches(bits: int):
    edges = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)

    def run(batches):
        for keys, counts in _counted(t for b in batches for _, t, _ in _tokens(b.column("text"))):
            at = np.append(np.searchsorted(keys, edges), len(keys))
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_squeeze(
                np.diff(keys[at[b]:at[b + 1]], prepend=np.uint64(0)), _narrow(counts[at[b]:at[b + 1]])) for b in full], pa.binary())],
                ["bucket", "words"])
    return run


def _write_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_spread(x) for x in table.column("words").to_pylist()]
        k, c = _summed(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]),
                       np.concatenate([p[1].astype(np.uint64) for p in parts]))
        put(f"{folder}/words-{bucket}", [k.astype(_U8).tobytes()])
        _put_small(f"{folder}/counts-{bucket}", c)
        return pa.table({"bucket": [bucket], "words": [len(k)], "tokens": [int(c.sum())]},
                        pa.schema([("bucket", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64())]))
    return run


@lru_cache(maxsize=4096)
def _array(path: str, kind: str) -> np.ndarray:
    return mapped(path, kind)


class Lexicon:
    """Words of a model by sorted hash: id = place among all; ``len`` of the lexicon for unknown ones."""

    def __init__(self, folder: str, bits: int, sizes: list[int]) -> None:
        self.folder, self.bits = folder, bits
        self.base = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        self.edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return int(self.base[-1])

    def end(self) -> int:
        return int(self.ids(np.array([_END]))[0])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes."""
        out = np.full(len(hashes), len(self), np.int64)
        cut = np.concatenate([[0], np.searchsorted(hashes, self.edges), [len(hashes)]])
        for b in range(1 << self.bits):
            lo, hi, n = cut[b], cut[b + 1], self.base[b + 1] - self.base[b]
            if lo < hi and n:
                have = _array(f"{self.folder}/words-{b}", _U8)
                at = np.searchsorted(have, hashes[lo:hi])
                at[at == n] = 0
                out[lo:hi] = np.where(have[at] == hashes[lo:hi], self.base[b] + at, len(self))
        return out

    def values(self, ids: np.ndarray, name: str, width: int = 1) -> np.ndarray:
        """Stored numbers of sorted ids that exist."""
        out = np.zeros((len(ids), width))
        cut = np.searchsorted(ids, self.base)
        for b in range(1 << self.bits):
            lo, hi = cut[b], cut[b + 1]
            if lo < hi:
                n = int(self.base[b + 1] - self.base[b])
                for k in range(width):
                    out[lo:hi, k] = _small(f"{self.folder}/{name}-{b}", width * n, ids[lo:hi] - self.base[b] + k * n)
        return out


def _grams(ids: np.ndarray, at: np.ndarray, order: int, size: int) -> np.ndarray:
    """(order, tokens): each token behind those before it; a text has a start (id size + 1) behind pads (size + 2)."""
    texts = np.arange(1, len(at))
    where = np.arange(len(ids)) + (order - 1) * np.repeat(texts, np.diff(at))
    line = np.full(len(ids) + (order - 1) * len(texts), size + 2, np.uint32)
    line[where] = ids
    line[at[:-1] + (order - 1) * texts - 1] = size + 1
    return np.stack([line[where - (order - 1) + k] for k in range(order)])


def _keys(grams: np.ndarray, bits: int, size: int) -> np.ndarray:
    """A 64-bit key of each gram, reversible for pairs. The bucket is that of the first two words behind pads."""
    a, b = grams[0].astype(np.uint64), grams[1].astype(np.uint64)
    key = W.mix((a << np.uint64(32)) | b)
    if len(grams) == 2:
        return key
    two = key
    for g in grams[2:]:
        key = W.mix(key + g.astype(np.uint64) * _STEP)
    if not bits:
        return key
    for k in range(1, len(grams) - 1):
        at = np.flatnonzero(grams[k] == size + 1)
        if len(at):
            two[at] = W.mix((grams[k][at].astype(np.uint64) << np.uint64(32)) | grams[k + 1][at].astype(np.uint64))
    low = np.uint64(64 - bits)
    return (two >> low << low) | (key >> np.uint64(bits))


def _edges(bits: int) -> np.ndarray:
    return (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)


def _merged(keys: np.ndarray, grams: np.ndarray, counts: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], grams[:, order[at]], np.add.reduceat(counts[order], at) if len(keys) else counts


def _counted_grams(parts, bits: int, size: int):
    """Sums of a stream of gram arrays, a few at a time, so that equal grams of a task are merged before they are sent."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = 0
    for grams in parts:
        held.append(_merged(_keys(grams, bits, size), grams, np.ones(grams.shape[1], np.uint64)))
        n += len(held[-1][0])
        if n > HELD:
            merged = _joined(held)
            held, n = [merged], len(merged[0])
            if n > HELD // 2:
                yield merged
                held, n = [], 0
                del merged
    if held:
        yield _joined(held)


def _joined(held: list):
    keys, grams, counts = zip(*held, strict=True)
    held.clear()
    return _merged(np.concatenate(keys), np.concatenate(grams, axis=1), np.concatenate(counts))


def _pack(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Grams and counts in order of the first two words."""
    order = np.argsort((grams[0].astype(np.uint64) << np.uint64(32)) | grams[1])
    return _squeeze(np.diff(grams[0][order], prepend=np.uint32(0)), *(g[order] for g in grams[1:]), _narrow(counts[order]))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, *rest, counts = _spread(blob)
    return np.stack([np.cumsum(first, dtype=np.uint32), *rest]), counts.astype(np.uint64)


def _dealt_grams(keys, grams, counts, bits: int) -> pa.Table:
    """One row per bucket from grams in the order of their keys."""
    at = np.append(np.searchsorted(keys, _edges(bits)), len(keys))
    full = np.flatnonzero(np.diff(at))
    return pa.table({"bucket": pa.array(full, pa.int32()), "kind": pa.array([0] * len(full), pa.int32()),
                     "ids": pa.array([_pack(grams[:, at[b]:at[b + 1]], counts[at[b]:at[b + 1]]) for b in full], pa.binary()),
                     "numbers": pa.array([b""] * len(full), pa.binary())})


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`verigauge.llm.words.mix`."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def _gram_batches(lexicon: Lexicon, order: int):
    def grams(batches):
        for b in batches:
            for _, tokens, at in _tokens(b.column("text")):
                u, back = np.unique(tokens, return_inverse=True)
                yield _grams(lexicon.ids(u)[back], at, order, len(lexicon))

    def run(batches):
        for some in _counted_grams(grams(batches), lexicon.bits, len(lexicon)):
            yield from _dealt_grams(*some, lexicon.bits).to_batches()
    return run


def _put_small(path: str, numbers: np.ndarray) -> None:
    """Numbers as bytes; those from 255 on behind them with their places."""
    big = np.flatnonzero(numbers >= 255)
    put(path, [np.minimum(numbers, 255).astype(np.uint8).tobytes(), big.astype(_U8).tobytes(), numbers[big].astype(_U8).tobytes()])


def _small(path: str, n: int, at: np.ndarray) -> np.ndarray:
    raw = _array(path, "u1")
    out = np.asarray(raw[at]).astype(np.float64)
    big = np.flatnonzero(out == 255)
    if len(big):
        places, values = raw[n:].view(_U8).reshape(2, -1)
        out[big] = values[np.searchsorted(places, at[big].astype(np.uint64))]
    return out


def _fine(bits: int, n: int) -> int:
    """Bits of a key that an index of the file stands for; 0: keys are stored whole."""
    fine = 24 - bits
    return fine if fine > 0 and 3 * n > 4 << fine else 0


def _put_keys(path: str, keys: np.ndarray, bits: int) -> None:
    fine = _fine(bits, len(keys))
    if not fine:
        put(path, [keys.astype(_U8).tobytes()])
        return
    top = (keys >> np.uint64(40)).astype(np.int64) & ((1 << fine) - 1)
    put(path, [np.searchsorted(top, np.arange((1 << fine) + 1)).astype(_U4).tobytes(),
               (keys & np.uint64(0xFFFFFFFF)).astype(_U4).tobytes(), (keys >> np.uint64(32)).astype(np.uint8).tobytes()])


def _places(path: str, n: int, bits: int, keys: np.ndarray) -> np.ndarray:
    """Places of keys of one bucket among the ``n`` of its file, -1 for those not there."""
    fine = _fine(bits, n)
    if not fine:
        have = _array(path, _U8)
        at = np.searchsorted(have, keys)
        at[at == n] = 0
        return np.where(have[at] == keys, at, -1)
    raw = _array(path, "u1")
    head = 4 * ((1 << fine) + 1)
    index, low, high = raw[:head].view(_U4), raw[head:head + 4 * n].view(_U4), raw[head + 4 * n:]
    top = (keys >> np.uint64(40)).astype(np.int64) & ((1 << fine) - 1)
    want = keys & np.uint64((1 << 40) - 1)
    lo, hi = index[top].astype(np.int64), index[top + 1].astype(np.int64)
    end = hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less = low[mid] | (high[mid].astype(np.uint64) << np.uint64(32)) < want[open_]
        lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    at = np.minimum(lo, n - 1)
    return np.where((lo < end) & (low[at] | (high[at].astype(np.uint64) << np.uint64(32)) == want), at, -1)


def _put_after(path: str, numbers: np.ndarray) -> None:
    """Followers of each context by count: (once, twice, more often, sum of the latter); mostly one byte."""
    once, twice, more, _ = numbers
    easy = (once < 16) & (twice < 15) & (more == 0)
    rest = np.flatnonzero(~easy)
    put(path, [np.where(easy, once + 16 * twice, 255).astype(np.uint8).tobytes(), rest.astype(_U4).tobytes(),
               *[x[rest].astype(_U4 if k < 3 else _U8).tobytes() for k, x in enumerate(numbers)]])


def _after(path: str, n: int, at: np.ndarray) -> np.ndarray:
    raw = _array(path, "u1")
    code = np.asarray(raw[at])
    out = np.stack([code & 15, code >> 4, code * 0, code * 0]).astype(np.float64)
    hard = np.flatnonzero(code == 255)
    if len(hard):
        m = (len(raw) - n) // 24
        column = [raw[n + 4 * m * k:n + 4 * m * (k + 1)].view(_U4) for k in range(4)] + [raw[n + 16 * m:].view(_U8)]
        where = np.searchsorted(column[0], at[hard])
        out[:, hard] = [c[where] for c in column[1:]]
    return out


def _write_grams(folder: str, lexicon: Lexicon, order: int):
    """Files of grams of one length; what they tell of grams shorter by one (of pairs: of words) goes on.

    A gram counts as often as it stands at a text start, else by its different words before. Contexts of a bucket are the
    shorter grams of the same bucket but those that end a text, in the same order, so they need no keys of their own.
    """
    bits, size = lexicon.bits, len(lexicon)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table
        parts = [_unpack(x) for x in table.column("ids").to_pylist()]
        grams, counts = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
        del parts
        keys, grams, counts = _merged(_keys(grams, bits, size), grams, counts)
        own = grams[0] != size + 2
        last = grams[-1] == lexicon.end()
        sizes = []
        for name, mine in (("grams", own & ~last), ("ends", own & last)):
            _put_keys(f"{folder}/{name}{order}-{bucket}", keys[mine], bits)
            _put_small(f"{folder}/{name}counts{order}-{bucket}", counts[mine])
            sizes.append(int(mine.sum()))
        few = np.bincount(np.minimum(counts[own], 5).astype(np.int64), minlength=6)
        out = [pa.table({"bucket": pa.array([-1], pa.int32()), "kind": pa.array([100 + order], pa.int32()),
                         "ids": pa.array([np.array([bucket, *sizes], _U8).tobytes()], pa.binary()),
                         "numbers": pa.array([few.astype(_U8).tobytes()], pa.binary())})]
        del keys
        if order == 2:
            return pa.concat_tables([*out, _words_of_pairs(grams, counts, lexicon.base)])
        c = counts[own]
        _, where = np.unique(_keys(grams[:-1, own], bits, size), return_inverse=True)
        n = int(where.max(initial=-1)) + 1
        _put_after(f"{folder}/after{order}-{bucket}", np.stack(
            [*(np.bincount(where[m], minlength=n) for m in (c == 1, c == 2, c > 2)),
             np.bincount(where[c > 2], c[c > 2].astype(np.float64), n).astype(np.int64)]))
        del where
        counts = np.where(own, np.uint64(1), counts)
        grams = grams[1:]
        out.append(_dealt_grams(*_merged(_keys(grams, bits, size), grams, counts), bits))
        return pa.concat_tables(out)
    return run


def _words_of_pairs(pairs: np.ndarray, counts: np.ndarray, base: np.ndarray) -> pa.Table:
    """What pairs tell of single words, by the words' own buckets (text starts: -1).

    Kind 0: different words before; kinds 1, 2, 3: words after it counted once, twice, more often; kind 4: sum of the last.
    """
    v, w = pairs.astype(np.int64)
    groups, kinds, ids, numbers = [], [], [], []
    for kind, mine, weight in ((0, w, None), (1, v[counts == 1], None), (2, v[counts == 2], None), (3, v[counts > 2], None),
                               (4, v[counts > 2], counts[counts > 2])):
        u, where = np.unique(mine, return_inverse=True)
        n = np.bincount(where, weight, len(u)).astype(np.int64)
        cut = np.append(np.searchsorted(u, base), len(u))
        for g in np.flatnonzero(np.diff(cut)).tolist():
            part, sums = u[cut[g]:cut[g + 1]], n[cut[g]:cut[g + 1]]
            groups.append(g if g < len(base) - 1 else -1)
            kinds.append(kind)
            ids.append(_squeeze(np.diff(part, prepend=0).astype(_U4), _narrow(sums)))
            numbers.append(b"")
    return pa.table({"bucket": pa.array(groups, pa.int32()), "kind": pa.array(kinds, pa.int32()),
                     "ids": pa.array(ids, pa.binary()), "numbers": pa.array(numbers, pa.binary())})


def _write_stats(folder: str, base: list[int]):
    """The numbers of one bucket of words as a file; counts of counts go back (of part -1: a row per file of grams)."""
    def run(table: pa.Table) -> pa.Table:
        part = table.column("bucket")[0].as_py()
        rows = list(zip(*(table.column(x).to_pylist() for x in ("kind", "ids", "numbers")), strict=True))
        if part < 0:
            totals, starts = [], np.zeros(4, np.int64)
            for kind, ids, numbers in rows:
                if kind >= 100:
                    totals.append([kind - 100, *np.frombuffer(ids, _U8).tolist(), *np.frombuffer(numbers, _U8)[1:].tolist()])
                else:
                    starts[kind - 1] += int(_spread(ids)[1].sum())
            totals.append([0, *starts.tolist()])
        else:
            n = base[part + 1] - base[part]
            out = np.zeros((5, n), np.uint64)
            for kind, ids, _ in rows:
                step, numbers = _spread(ids)
                out[kind, np.cumsum(step.astype(np.int64)) - base[part]] += numbers.astype(np.uint64)
            _put_small(f"{folder}/stats-{part}", out.ravel())
            few = np.bincount(np.minimum(out[0], 5).astype(np.int64), minlength=6)
            totals = [[1, *few[1:].tolist(), int(out[0].sum())]]
        return pa.table({"totals": pa.array(totals, pa.list_(pa.int64()))})
    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from how many things were counted 1, 2, 3 and 4 times; halves where that says nothing."""
    out = [0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in range(3):
            if n[k] and n[k + 1]:
                d = (k + 1) - (k + 2) * y * n[k + 1] / n[k]
                out[k] = d if 0 < d <= k + 1 else out[k]
    return out


class Model:
    """A counted model; pickles as a few numbers and a folder name."""

    def __init__(self, folder, lexicon, order, tokens, texts, totals) -> None:
        self.folder, self.lexicon, self.order, self.tokens, self.texts = folder, lexicon, order, tokens, texts
        counts = {k: [0] * 5 for k in range(1, order + 1)}
        #: (length, bucket) -> grams and grams that end a text
        self.sizes, self.starts, self.pairs = {}, [0] * 4, 0
        for k, *t in totals:
            if not k:
                self.starts = t
            elif k == 1:
                counts[1] = [a + b for a, b in zip(counts[1], t, strict=False)]
                self.pairs += t[5]
            else:
                counts[k] = [a + b for a, b in zip(counts[k], t[3:], strict=True)]
                self.sizes[k, t[0]] = t[1], t[2]
        self.d = {k: discounts(c) for k, c in counts.items()}
        m = [counts[1][0], counts[1][1], sum(counts[1][2:])]
        self.floor = (sum(d * k for d, k in zip(self.d[1], m, strict=True)) / self.pairs if self.pairs else 1.0) / (len(lexicon) + 1)

    def score(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, base log10 probability, known) of every token."""
        lex = self.lexicon
        v_all = len(lex)
        u, back = np.unique(tokens, return_inverse=True)
        ids = lex.ids(u)
        known = ids < v_all
        order = np.argsort(ids[known])
        there = np.flatnonzero(known)[order]
        count, stats = np.zeros(len(u)), np.zeros((len(u), 5))
        count[there] = lex.values(ids[there], "counts")[:, 0]
        stats[there] = lex.values(ids[there], "stats", 5)
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (v_all + 1)))
        single = np.full(len(u), self.floor)
        n = stats[:, 0]
        some = n > 0
        d = np.array([0.0, *self.d[1]])[np.minimum(n, 3).astype(int)]
        single[some] += (n[some] - d[some]) / max(1, self.pairs)
        p = single[back]
        grams = _grams(ids[back], at, self.order, v_all)
        # words between a token and the start of its text
        gone = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
        places = np.zeros(0, np.int64)
        for k in range(2, self.order + 1):
            mine = np.flatnonzero(gone >= k - 2)
            if k == 2:
                before = back[np.maximum(mine - 1, 0)]
                after = np.where(gone == 0, np.array(self.starts, float)[:, None], stats[before, 1:].T)
            else:
                after = self._after(k, places[mine - 1])
            total = after[0] + 2 * after[1] + after[3]
            gap = np.array(self.d[k]) @ after[:3]
            c, found = self._counts(k, grams[self.order - k:, mine])
            d = np.array([0.0, *self.d[k]])[np.minimum(c, 3).astype(int)]
            p[mine] = np.where(total > 0, (c - d + gap * p[mine]) / np.maximum(total, 1), p[mine])
            places = np.full(len(tokens), -1)
            places[mine] = found
        return np.log10(p), base[back], known[back]

    def _counts(self, k: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often grams of length ``k`` count, and the bucket and place of those that can be a context (else -1)."""
        lex = self.lexicon
        keys, first, where = np.unique(_keys(grams, lex.bits, len(lex)), return_index=True, return_inverse=True)
        last = grams[-1][first] == lex.end()
        out, places = np.zeros(len(keys)), np.full(len(keys), -1)
        cut = np.append(np.searchsorted(keys, _edges(lex.bits)), len(keys))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            for name, mine, n in zip(("grams", "ends"), (~last, last), self.sizes.get((k, b), (0, 0)), strict=True):
                mine = cut[b] + np.flatnonzero(mine[cut[b]:cut[b + 1]])
                if not n or not len(mine):
                    continue
                at = _places(f"{self.folder}/{name}{k}-{b}", n, lex.bits, keys[mine])
                mine, at = mine[at >= 0], at[at >= 0]
                out[mine] = _small(f"{self.folder}/{name}counts{k}-{b}", n, at)
                if name == "grams":
                    places[mine] = at + (b << 40)
        return out[where], places[where]

    def _after(self, k: int, places: np.ndarray) -> np.ndarray:
        """Numbers of words after the contexts of grams of length ``k``."""
        u, where = np.unique(places, return_inverse=True)
        out = np.zeros((4, len(u)))
        cut = np.searchsorted(u, np.arange((1 << self.lexicon.bits) + 1) << 40)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = cut[b], cut[b + 1]
            out[:, lo:hi] = _after(f"{self.folder}/after{k}-{b}", self.sizes[k - 1, b][0], u[lo:hi] - (b << 40))
        return out[:, where]


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """A model of grams up to ``order`` words of all texts of ``docs`` (null: empty, that is one end token)."""
    if order < 2:
        raise ValueError("the order of a model is 2 at least")
    spark = docs.sparkSession
    folder = fresh(spark, "model")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    n, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, chars / BUCKET_CHARS)))))
    rows = (texts.mapInArrow(_word_batches(bits), "bucket int, words binary").groupBy("bucket")
            .applyInArrow(_write_words(folder), "bucket int, words long, tokens long").collect())  # a row per bucket
    sizes = {r["bucket"]: r["words"] for r in rows}
    lexicon = Lexicon(folder, bits, [sizes.get(b, 0) for b in range(1 << bits)])
    if len(lexicon) >= (1 << 32) - 3:
        raise ValueError("more than 2**32 - 4 distinct words: ids do not fit")
    kinds = "bucket int, kind int, ids binary, numbers binary"
    at = texts.mapInArrow(_gram_batches(lexicon, order), kinds)
    for k in range(order, 1, -1):
        at = at.groupBy("bucket").applyInArrow(_write_grams(folder, lexicon, k), kinds)
    done = at.groupBy("bucket").applyInArrow(_write_stats(folder, lexicon.base.tolist()), "totals array<long>").collect()  # a row per file
    return Model(folder, lexicon, order, sum(r["tokens"] for r in rows), n, [r["totals"] for r in done])


def _score_batches(model: Model):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            out = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
            for lo, tokens, at in _tokens(batch.column("text")):
                hi = lo + len(at) - 1
                p, base, known = model.score(tokens, at)
                out[0][lo:hi] = np.diff(at)
                for k, x in ((1, known.astype(np.int64)), (2, base), (3, p)):
                    out[k][lo:hi] = np.add.reduceat(x, at[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, out)],
                                             ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
                order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document.

    The model has grams of up to ``order`` words. It learns from documents whose crc32 of the id as text has a remainder by ``folds`` other than 0; the others,
    and those without an id, are held out. Null texts are empty: one end token. Without any text to learn from all
    tokens are equally likely. Repeated rows count and repeat; other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True)).alias("held_out"))
    model = train(slim.where("NOT held_out"), order=order)
    kind = slim.schema["doc_id"].dataType.simpleString()
    return (slim.mapInArrow(_score_batches(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                                   "base_score double, score double")
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                    "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")))
