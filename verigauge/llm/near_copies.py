"""MinHash near-dedup: order min-hash sketches, banded candidates, alignment of occurrence-labelled shingles.

Words are runs of letters and digits of the lower-cased text (every non-ASCII character counts as a
letter). A shingle is five words, a shorter text is one shingle. Each shingle carries its number among
equal ones before it, so within a text all labelled shingles differ. One sketch takes the two labelled
shingles that are smallest under its hash and keeps them in text order: moved text changes it, unlike a
plain min-hash. A band is two sketches; texts that share a band and agree in enough sketches are
candidates. A candidate pair is verified by a banded alignment of the two sequences of labelled
shingles: as labels are unique in a text, the best alignment is the longest chain of matches that rises
in both texts, over matches no further from the diagonal than a similar pair can be.
similarity = chain / (shingles of both - chain).

With a similarity of 0.8 a pair shares a band with probability above 0.9999 (20 bands of 4 shingles).
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm import words as W
from verigauge.llm.graphs import components
from verigauge.llm.store import kept, release, tidy, unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
SKETCHES = 2 * BANDS
#: Buckets up to this size compare all their texts; larger ones go by rounds around one text.
SMALL_BUCKET = 8
#: Pairs that one copy of a text serves.
PAIRS_AT_ONCE = 256
#: Texts, and shingles of them, on either side of a block of a crowded bucket.
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Of 40 sketches a pair of similarity 0.8 shares 27 on average, with a deviation of 3: fewer than 10 in one of 10^8 pairs.
LEAST_SHARED = 10

_SEEDS = W.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = W.mix(_SEEDS) | np.uint64(1)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _labelled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, labelled hashes, first shingle of each text)."""
    starts, ends, first = W.spans(data, offsets, W.MARKS)
    values, at = W.shingles(W.hashes(data, starts, ends), first, SHINGLE)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return values, W.mix(values + W.occurrences(values, text).astype(np.uint64) * _A), at


def _sketch(values: np.ndarray, labelled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sketches of all texts that have shingles, SKETCHES numbers each."""
    counts = np.diff(at)
    full = np.flatnonzero(counts)
    begin, counts = at[:-1][full], counts[full]
    out = np.empty((len(full), SKETCHES), np.uint64)
    text = np.repeat(np.arange(len(full)), counts)
    for k in range(SKETCHES):
        x = (labelled ^ _SEEDS[k]) * _FACTORS[k]
        x ^= x >> np.uint64(32)
        least = np.minimum.reduceat(x, begin)
        one = np.flatnonzero(x == least[text])
        one = one[np.searchsorted(text[one], np.arange(len(full)))]
        x[one] = _TOP
        least = np.minimum.reduceat(x, begin)
        two = np.flatnonzero(x == least[text])
        two = two[np.searchsorted(text[two], np.arange(len(full)))]
        lo, hi = np.minimum(one, two), np.maximum(one, two)
        out[:, k] = W.mix(values[lo] * _A + values[hi] * _B + np.uint64(k))
    return out


def _sketch_batches(batches):
    """(node, text) -> (node, shingles, bands, lanes): lanes hold three bits of each sketch."""
    for batch in batches:
        nodes, column = batch.column("node"), W.strings(batch.column("text"), lower=True)
        for lo, hi, data, offsets in W.slices(column):
            values, labelled, at = _labelled(data, offsets)
            counts = np.diff(at)
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            s = _sketch(values, labelled, at)
            bands = W.mix(s[:, ::2] * _A + s[:, 1::2] * _B)
            shift = np.arange(SKETCHES, dtype=np.uint64)
            lanes = [np.bitwise_or.reduce(((s >> np.uint64(7 + 9 * b)) & np.uint64(1)) << shift, axis=1)
                     for b in range(3)]
            yield pa.RecordBatch.from_arrays(
                [nodes.slice(lo, hi - lo).take(pa.array(full)), pa.array(counts[full], pa.int64()),
                 pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32),
                                          pa.array(W.as_signed(np.ascontiguousarray(bands)).ravel())),
                 *[pa.array(W.as_signed(x)) for x in lanes]],
                ["node", "shingles", "bands", "l0", "l1", "l2"])
        release()


def chain(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest chain of equal values rising in both; values are unique on each side."""
    order = np.argsort(b)
    at = np.searchsorted(b, a, sorter=order)
    at[at == len(b)] = 0
    j = order[at] if len(b) else at
    hit = np.flatnonzero(b[j] == a) if len(b) else at[:0]
    hit = hit[np.abs(hit - j[hit]) <= band]
    j = j[hit]
    if len(j) < 2 or bool(np.all(j[1:] > j[:-1])):
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect.bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned similarity of two sequences of labelled shingles, exact from ``threshold`` on."""
    need = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < need - 1e-9:
        return 0.0
    n = chain(a, b, int(max(len(a), len(b)) - need + 1e-9) + 1)
    return n / (len(a) + len(b) - n) if n else 0.0


def _byte_runs(columns: list[pa.Array], limit: int = W.SLICE_BYTES):
    """(first row, end row) of runs whose texts have about ``limit`` bytes together, or one row."""
    size = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(c), 0)).astype(np.int64) for c in columns))
    lo = 0
    while lo < len(size):
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + limit, "right")))
        yield lo, hi
        lo = hi


def _verify_batches(threshold: float):
    """Few texts at a time: a run of pairs is lower-cased, cut into shingles and compared before the next one is looked at."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [batch.column("text_a"), batch.column("text_b")]
            sim = []
            for lo, hi in _byte_runs(texts):
                sides = []
                for column in texts:
                    mine = []
                    for _, _, data, offsets in W.slices(W.strings(column.slice(lo, hi - lo), lower=True)):
                        _, labelled, at = _labelled(data, offsets)
                        mine += np.split(labelled, at[1:-1])
                    sides.append(mine)
                sim += [similarity(a, b, threshold) for a, b in zip(*sides, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], ["a", "b", "similarity"])
            del batch, texts
            release()
            yield out
    return run


def _bucket_rows(sketches: DataFrame) -> DataFrame:
    return sketches.select("node", "shingles", "l0", "l1", "l2", F.posexplode("bands").alias("band", "key"))


def _alike(threshold: float):
    shared = F.bit_count((F.col("x.l0").bitwiseXOR(F.col("y.l0")))
                         .bitwiseOR(F.col("x.l1").bitwiseXOR(F.col("y.l1")))
                         .bitwiseOR(F.col("x.l2").bitwiseXOR(F.col("y.l2"))))
    return ((shared <= SKETCHES - LEAST_SHARED)
            & (F.least("x.shingles", "y.shingles") >= threshold * F.greatest("x.shingles", "y.shingles")))


def _pairs(x: DataFrame, y: DataFrame, extra, threshold: float) -> DataFrame:
    return (x.alias("x").join(y.alias("y"), ["band", "key"]).where(extra & _alike(threshold))
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links among candidate pairs. Texts meet their pairs by node; the text of a node in very many pairs comes
    in copies, each for a share of them, so that no task gets them all."""
    sides = pairs.select("a", "b", F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(0).alias("side")),
        F.struct(F.col("b").alias("node"), F.lit(1).alias("side")))).alias("s")).select("a", "b", "s.*")
    busy = kept(sides.groupBy("node").agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).alias("shares")).where("shares > 1"))
    plain = sides.join(busy, "node", "left_anti").join(texts, "node").select("a", "b", "side", "text")
    copies = texts.join(busy, "node").select("node", "text", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    dealt = sides.join(busy, "node").withColumn("share", F.pmod(F.xxhash64("a", "b"), F.col("shares")))
    both = (plain.unionByName(dealt.join(copies, ["node", "share"]).select("a", "b", "side", "text")).groupBy("a", "b")
            .agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("text_a"),
                 F.max(F.when(F.col("side") == 1, F.col("text"))).alias("text_b")))
    return (both.mapInArrow(tidy(_verify_batches(threshold)), "a binary, b binary, similarity double")
            .where(F.col("similarity") >= threshold))


def text_links(texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between distinct texts (node, text) that span every near-copy group.

    Two texts of one bucket end up connected if any chain of similar texts within buckets joins them,
    as if all pairs of all buckets were compared. Small buckets compare all pairs. A large bucket first
    links its texts with its smallest one; then only texts outside the largest part so found are compared
    with the others, in blocks, until all that belong together are. No bucket is cut and none is collected.
    """
    sketches = kept(texts.mapInArrow(tidy(_sketch_batches), "node binary, shingles long, bands array<long>, "
                                                      "l0 long, l1 long, l2 long"))
    rows = _bucket_rows(sketches)
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1")
    # a table of its own on either side lets Spark split the rows of a hot key
    sized = kept(rows.join(kept(sizes), ["band", "key"]))
    small, large = sized.where(F.col("n") <= SMALL_BUCKET), sized.where(F.col("n") > SMALL_BUCKET)
    pairs = _pairs(small, small, F.col("x.node") < F.col("y.node"), threshold)
    heads = large.where(F.col("node") == F.col("head"))
    pairs = kept(pairs.unionByName(_pairs(heads, large, F.col("x.node") != F.col("y.node"), threshold)).distinct())
    links = kept(_verified(pairs, texts, threshold))
    if large.isEmpty():
        return links.select("a", "b")
    parts = components(links)
    named = large.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    named = kept(named.select("band", "key", "node", "part", "shingles"))
    counts = named.groupBy("band", "key", "part").agg(F.count("*").alias("m"))
    most = kept(counts.groupBy("band", "key").agg(F.max_by("part", F.struct("m", "part")).alias("main"),
                                                  F.count("*").alias("n_parts")).where("n_parts > 1"))
    members = kept(named.join(most.select("band", "key", "main"), ["band", "key"])
                   .groupBy("main", "node", "part").agg(F.first(F.col("part") != F.col("main")).alias("apart"), F.first("shingles").alias("shingles")))
    return links.select("a", "b").unionByName(_across(members, texts, threshold))


def _across(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between texts outside the main part of their crowded buckets and all other texts there, in blocks."""
    def blocks(which):
        return F.greatest(F.ceil(F.sum(which.cast("int")) / BLOCK), F.ceil(F.sum(F.when(which, F.col("shingles"))) / BLOCK_SHINGLES))
    sizes = members.groupBy("main").agg(blocks(F.col("apart")).alias("ni"), blocks(F.lit(True)).alias("nj"))
    placed = members.join(sizes, "main").select(
        "*", F.pmod(F.xxhash64("node"), F.col("ni")).alias("mi"), F.pmod(F.xxhash64("node", "part"), F.col("nj")).alias("mj"))
    rows = (placed.where("apart").select("main", "node", "part", F.col("mi").alias("i"),
                                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)).alias("j"), F.lit(True).alias("query"))
            .unionByName(placed.select("main", "node", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)).alias("i"),
                                       F.col("mj").alias("j"), F.lit(False).alias("query"))))
    return (rows.join(texts, "node").groupBy("main", "i", "j")
            .applyInPandas(lambda block: _compare_block(block, threshold), "a binary, b binary"))


def _compare_block(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links that join parts not yet joined, among the queries and the other texts of a block.

    Shared shingles are counted by matrix products; they bound the aligned similarity, so only pairs
    that reach the threshold so far and are still apart get aligned.
    """
    block = block.sort_values("query", ascending=False, kind="stable")
    labelled = []
    for _, _, data, offsets in W.slices(W.strings(pa.array(block["text"], pa.large_string()), lower=True)):
        _, x, at = _labelled(data, offsets)
        labelled += np.split(x, at[1:-1])
    q = int(block["query"].sum())
    size = np.array([len(x) for x in labelled])
    owner = np.repeat(np.arange(len(size)), size)
    _, shingle = np.unique(np.concatenate(labelled), return_inverse=True)
    left = np.bincount(shingle[owner < q], minlength=shingle.max(initial=0) + 1) > 0
    right = np.bincount(shingle[owner >= q], minlength=len(left)) > 0
    new = np.cumsum(left & right) - 1
    use = (left & right)[shingle]
    shingle, owner = new[shingle[use]], owner[use]
    both = np.zeros((q, len(size) - q), np.float32)
    for c in range(0, int(shingle.max(initial=-1)) + 1, 4096):
        m = np.zeros((len(size), 4096), np.float32)
        mine = (shingle >= c) & (shingle < c + 4096)
        m[owner[mine], shingle[mine] - c] = 1
        both += m[:q] @ m[q:].T
    score = both / (size[:q, None] + size[None, q:] - both)
    i, j = np.nonzero(score >= threshold - 1e-6)
    order = np.argsort(-score[i, j], kind="stable")
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    node, part = block["node"].tolist(), block["part"].tolist()
    found = []
    for a, b in zip(i[order].tolist(), (j[order] + q).tolist(), strict=True):
        x, y = root(part[a]), root(part[b])
        if x != y and similarity(labelled[a], labelled[b], threshold) >= threshold:
            parent[x] = y
            found.append((node[a], node[b]))
    del labelled, both, score, owner, shingle, use
    release()
    return pd.DataFrame({"a": [f[0] for f in found], "b": [f[1] for f in found]})


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, kept) for every document.

    Documents with equal texts are one class member; classes are connected by pairs of aligned similarity
    >= ``threshold``. ``class_id`` is the smallest id of the class, ``kept`` marks the row that has it.
    A null id counts as larger than all others; a class of null ids only has a null ``class_id``.
    Null texts and texts without a word resemble nothing: each is a class by itself. Repeated rows share a
    class, and each of them that carries the smallest id is marked. An empty
    table gives no rows; other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = slim.withColumn("node", F.unhex(F.md5("text")))
    texts = named.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("text").alias("text"))
    groups = components(text_links(texts, threshold))
    ids = named.select("doc_id", F.when(F.col("text").rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]"), F.col("node"))
                       .alias("node"))
    alone = ids.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"),
                                             F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    placed = (ids.where("node IS NOT NULL").join(groups, "node", "left")
              .select("doc_id", F.coalesce("component", "node").alias("class")))
    heads = kept(placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return (placed.join(heads, "class")
            .select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
            .unionByName(alone))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class of :func:`near_copy_classes`, all columns: the one with the smallest id.

    Of rows that share that id within the class one stays, the one whose columns have the smallest hash. Rows
    without words all stay, each being a class by itself.
    """
    node, row, twice = unused(docs, "node", "row", "twice")
    names = [F.col(f"`{c}`") for c in docs.columns]
    wordy = F.col(text_col).rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]")
    text = F.col(text_col).cast("string")
    slim = kept(docs.where(wordy).select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("node"), F.xxhash64(*names).alias("row")))
    texts = docs.where(wordy).select(F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    groups = components(text_links(texts.groupBy("node").agg(F.first("text").alias("text")), threshold))
    heads = (slim.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("class"))
             .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "node")).alias("head"))
             .select(F.col("head.row").alias(row), F.col("head.node").alias(node)))
    # a head that several equal rows share comes once
    many = (slim.groupBy("node", "row").agg(F.count("*").alias("n")).where("n > 1")
            .select(F.col("node").alias(node), F.col("row").alias(row), F.lit(True).alias(twice)))
    heads = kept(heads.join(many, [node, row], "left"))
    found = docs.where(wordy).withColumns({node: F.unhex(F.md5(text)), row: F.xxhash64(*names)}).join(heads, [node, row])
    single = found.where(F.col(twice).isNull()).select(*names)
    again = found.where(F.col(twice)).dropDuplicates([node, row]).select(*names)
    return single.unionByName(again).unionByName(docs.where(~F.coalesce(wordy, F.lit(False))))
