"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents, each packed into the fewest bits that the vocabulary needs. Ids
stand in blocks of ``BLOCK`` ids; a block starts at a byte boundary, so an index of block offsets gives any
id in constant time and NumPy unpacks whole blocks. Layout, little-endian:

    magic  8 bytes  b"PACKIDS1"
    blocks          packed ids, one block after the other
    offsets         unsigned 64: place of each block in the file, then the end of the last
    starts          unsigned 64: first id of each document, then the number of ids
    footer          unsigned 64: number of blocks, documents, bits per id, ids per block; magic again

Documents are dealt by ranges of their id; each partition is tokenised and written by one task as one file, in one step, so
a lost or repeated task leaves no half file. Only a line per file reaches the driver.
"""

from __future__ import annotations

import io
import struct
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm.store import fresh, kept, mapped, opened, put, tidy

MAGIC = b"PACKIDS1"
BLOCK = 1 << 16
END = 1
_FOOTER = "<4Q8s"
#: Distinct words whose ids a task remembers.
REMEMBERED = 500_000


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return raw[:n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    spread = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits).astype(np.uint32)
    return (spread << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class IdFile:
    """Random access to a file of packed ids, memory-mapped."""

    def __init__(self, uri: str) -> None:
        self.raw = mapped(uri, "u1")
        size = struct.calcsize(_FOOTER)
        blocks, docs, self.bits, self.block, magic = struct.unpack(_FOOTER, self.raw[-size:].tobytes())
        if magic != MAGIC or self.raw[:8].tobytes() != MAGIC:
            raise ValueError(f"not a file of packed ids: {uri}")
        end = len(self.raw) - size
        self.starts = self.raw[end - 8 * (docs + 1):end].view("<u8").astype(np.int64)
        end -= 8 * (docs + 1)
        self.offsets = self.raw[end - 8 * (blocks + 1):end].view("<u8").astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the file; only their blocks are read."""
        parts = []
        for b in range(lo // self.block, -(-hi // self.block)):
            n = min(self.block, int(self.starts[-1]) - b * self.block)
            ids = unpack(self.raw[self.offsets[b]:self.offsets[b + 1]], n, self.bits)
            parts.append(ids[max(0, lo - b * self.block):hi - b * self.block])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def file_chunks(documents, bits: int, block: int = BLOCK):
    """The bytes of a file, from an iterator over id arrays; holds one block and 8 bytes per document."""
    yield MAGIC
    offsets, starts, at, total, held, n = [], [], 8, 0, [], 0
    for ids in documents:
        starts.append(total)
        total += len(ids)
        held.append(ids)
        n += len(ids)
        if n < block:
            continue
        flat = np.concatenate(held)
        cut = n // block * block
        for lo in range(0, cut, block):
            raw = pack(flat[lo:lo + block], bits)
            offsets.append(at)
            at += len(raw)
            yield raw
        held, n = [flat[cut:]], n - cut
    if n:
        raw = pack(np.concatenate(held), bits)
        offsets.append(at)
        at += len(raw)
        yield raw
    yield np.array([*offsets, at], "<u8").tobytes()
    yield np.array([*starts, total], "<u8").tobytes()
    yield struct.pack(_FOOTER, len(offsets), len(starts), bits, block, MAGIC)


class Encoder:
    """Ids of the distinct pieces of texts, each encoded once.

    For tokenizers that drop white space and mark the ends of words, so that a piece between ASCII white space has the
    same ids in any text, and letters are apart from the marks behind them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.number: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.hits = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each piece and the end)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=at[1:])
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(at[-1])), at

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters: many are encoded as one text, whose ids are cut at the word ends."""
        ids, _ = self._each([" ".join(words[k:k + 256]) for k in range(0, len(words), 256)])
        cut = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.concatenate([[0], cut])) if len(cut) == len(words) else self._each(words)

    def _learn(self, new: list[bytes]) -> None:
        words: dict[str, int] = {}
        rest: dict[str, int] = {"": 0}
        core, tail = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        for k, p in enumerate(new):
            stem = p.rstrip(b".,;:!?")
            word = stem.decode()
            if word.isalpha() and (len(word) == len(stem) or word.lower().isalpha() and unicodedata.is_normalized("NFC", word)):
                core[k] = words.setdefault(word, len(words))
                tail[k] = rest.setdefault(p[len(stem):].decode(), len(rest))
            else:
                core[k] = -1
                tail[k] = rest.setdefault(p.decode(), len(rest))
        (a, at), (b, bt) = self._letters(list(words)), self._each(list(rest))
        n = np.where(core >= 0, at[core + 1] - at[core], 0) if len(words) else np.zeros(len(new), np.int64)
        m = bt[tail + 1] - bt[tail]
        first = len(self.number)
        while first + len(new) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.begin[first + 1:first + len(new) + 1] = self.used + np.cumsum(n + m)
        start = self.begin[first:first + len(new)]
        while self.begin[first + len(new)] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        for source, begin, count, to in ((a, at[core] if len(words) else core, n, start), (b, bt[tail], m, start + n)):
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            self.flat[np.repeat(to, count) + inner] = source[np.repeat(begin, count) + inner]
        self.used = int(self.begin[first + len(new)])
        self.number.update(zip(new, range(first, first + len(new)), strict=True))

    def _forget(self) -> None:
        """Make room: pieces met once since the last time go, then those met least."""
        n = len(self.number)
        least = max(2, int(np.partition(self.hits[:n], n // 2)[n // 2]) + 1)
        stay = np.flatnonzero(self.hits[:n] >= least)
        size = (self.begin[1:n + 1] - self.begin[:n])[stay]
        start = np.zeros(len(stay) + 1, np.int64)
        np.cumsum(size, out=start[1:])
        self.flat[:start[-1]] = self.flat[np.repeat(self.begin[stay] - start[:-1], size) + np.arange(start[-1])]
        self.begin[:len(start)], self.used = start, int(start[-1])
        kept = set(stay.tolist())
        self.number = {p: i for i, p in enumerate(p for k, p in enumerate(self.number) if k in kept)}
        self.hits[:] = 0

    def encode(self, texts: list[bytes], end: int | None = END) -> list[np.ndarray]:
        """Ids of whole texts (UTF-8), each with ``end`` behind it."""
        # special tokens are looked for before letters become small
        pieces = [(t if b"<|" in t else t.lower()).split() for t in texts]
        sizes = np.array([len(p) for p in pieces], np.int64)
        flat = list(chain.from_iterable(pieces))
        if len(self.number) > REMEMBERED:
            self._forget()
        k = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        unknown = np.flatnonzero(k < 0)
        if len(unknown):
            words = [flat[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(words)))
            k[unknown] = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.hits) < len(self.begin):
            self.hits = np.concatenate([self.hits, np.zeros(len(self.begin) - len(self.hits), np.int32)])
        self.hits[:len(self.number)] += np.bincount(k, minlength=len(self.number)).astype(np.int32)
        begin, n = self.begin[k], self.begin[k + 1] - self.begin[k]
        upto = np.zeros(len(k) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        ids = self.flat[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])]
        cut = upto[np.cumsum(sizes)]
        tail = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
        return [np.concatenate([x, tail]) for x in np.split(ids, cut[:-1])] if texts else []


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(texts: list[bytes], path: str, end: int | None = END) -> list[np.ndarray]:
    return _encoder(path).encode(texts, end)


def vocabulary(path: str) -> int:
    return _encoder(path).tokenizer.get_vocab_size()


def _write_batches(folder: str, path: str, bits: int):
    def run(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        ids, counts = [], []

        def documents():
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    some = batch.slice(lo, 256)
                    ids.extend(some.column("id").to_pylist())
                    texts = [(t or "").encode() for t in some.column("text").to_pylist()]
                    for x in encode(texts, path):
                        counts.append(len(x))
                        yield x
        uri = f"{folder}/ids-{part:06d}.bin"
        put(uri, file_chunks(documents(), bits))
        if not ids:
            return
        out = io.BytesIO()
        np.savez_compressed(out, ids=np.array([0 if i is None else i for i in ids], np.int64),
                            null=np.array([i is None for i in ids]))
        put(f"{folder}/docs-{part:06d}.npz", [out.getvalue()])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(ids)], pa.int64()),
                                          pa.array([sum(counts)], pa.int64())], ["part", "uri", "documents", "ids"])
    return run


def write_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents in ascending id order; (part, uri, documents, ids, start) per file.

    Null texts are empty, ids null come first, equal ids in the order of a hash of their texts. Every document ends
    with the end id. An empty table writes nothing; other columns are not looked at.
    """
    folder = fresh(docs.sparkSession, "tokens")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = ["id", F.xxhash64("text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    files = kept(ranged.mapInArrow(tidy(_write_batches(folder, tokenizer, bits_for(vocabulary(tokenizer)))),
                                   "part int, uri string, documents long, ids long"))
    sizes = files.select("part", "ids").orderBy("part").collect()  # one row per file
    starts = np.cumsum([0, *[r["ids"] for r in sizes]]).tolist()
    base = docs.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts, strict=False)], "part int, start long")
    return files.join(base, "part")


def _read_batches(batches):
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
            f = IdFile(uri)
            system, place = opened(uri.replace("/ids-", "/docs-").removesuffix(".bin") + ".npz")
            with system.open_input_file(place) as raw, np.load(io.BytesIO(raw.read())) as z:
                ids, null = z["ids"], z["null"]
            for lo in range(0, len(ids), 4096):
                n = np.diff(f.starts[lo:lo + 4097])
                crc = [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(lo, min(lo + 4096, len(ids)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:lo + 4096], mask=null[lo:lo + 4096]), pa.array(start + f.starts[lo:lo + len(n)]), pa.array(n),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; one task reads a file."""
    spread = files.select("uri", "start").repartitionByRange(max(1, files.count()), "start")
    return spread.mapInArrow(tidy(_read_batches), "doc_id long, start long, n_tokens long, ids_crc32 long")
