"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in NumPy.

A word is a run of letters and digits of the lower-cased text (non-ASCII characters count as letters). Its
subwords are the word itself and all its character n-grams of 3 to 5, edges included, hashed into buckets. A
text is the mean of the vectors of all its subwords; a softmax over two classes reads that mean. Vectors and softmax
are fitted together by mini-batches of Adam, so a misspelling never seen shares n-grams with words seen.

Training takes a bounded sample: at most ``SAMPLE`` labelled texts of either class, the first ones in the order of a
hash of the id. It runs in one task on counts of subwords. As mean and softmax are both
linear, what scoring needs of the model is one number per bucket, which goes to all tasks (1 MB).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm import words as W
from verigauge.llm.store import release, tidy

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
DIM = 8
#: Most labelled texts of one class that training reads.
SAMPLE = 2000
#: Means of many subwords differ by little; the softmax reads them at this scale.
SCALE = 60.0
EPOCHS = 8
BATCH = 512
#: Buckets in fewer texts of the sample, of either label, keep no weight: what one text alone says proves nothing.
LEAST_TEXTS = 2
DECAY = 0.002
#: Each clean text also lends this many pieces of so many words, so that no single clean word looks toxic.
PIECES = 24
PIECE = 4

#: Text that is scored at once: its subwords take about a hundred times as much memory.
SCORED_BYTES = 1 << 19

_WORD = np.uint64(0xA0761D6478BD642F)


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every subword of the given words."""
    raw = data.tobytes()
    joined = "\n" + b"\n".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)).decode() + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = chars == 10
    word = np.cumsum(edge) - 1
    edges = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(edge, out=edges[1:])
    at = np.flatnonzero(edge)
    sums = W.prefix_sums(chars)
    whole = W.range_hashes(sums, at[:-1] + 1, at[1:])
    buckets, owners = [W.mix(whole ^ _WORD) % np.uint64(BUCKETS)], [np.arange(len(at) - 1)]
    for size in SIZES:
        values = W.windows(chars, size, seed=size)
        i = np.arange(len(values))
        # an edge may stand first or last, not inside
        fine = edges[i + size - 1] - edges[np.minimum(i + 1, i + size - 1)] == 0
        owner = word[i]
        fine &= owner < len(at) - 1
        buckets.append(values[fine] % np.uint64(BUCKETS))
        owners.append(owner[fine])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _distinct(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends) of the distinct words, the distinct word that each word is, and the first word of each text."""
    starts, ends, first = W.spans(data, offsets, W.MARKS)
    _, at, back = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[at], ends[at], back, first


def _bags(batches):
    """(label, text) -> (label, buckets, counts, whole): a row per text, and one per piece of a clean text."""
    for batch in batches:
        labels = batch.column("label")
        for lo, hi, data, offsets in W.slices(W.strings(batch.column("text"), lower=True)):
            starts, ends, back, first = _distinct(data, offsets)
            bucket, owner = _subwords(data, starts, ends)
            order = np.argsort(owner, kind="stable")
            bucket, owner = bucket[order], owner[order]
            n = np.bincount(owner, minlength=len(starts))
            begin = np.cumsum(n) - n
            rows = []
            tags = labels.slice(lo, hi - lo).to_pylist()
            bags = [(tag, first[t], first[t + 1]) for t, tag in enumerate(tags)]
            # pieces of a clean text are clean
            bags += [(0, i, min(i + PIECE, first[t + 1])) for t, tag in enumerate(tags) if tag == 0 for i in np.unique(
                np.linspace(first[t], max(first[t], first[t + 1] - PIECE), PIECES).astype(int)).tolist()]
            whole = np.arange(len(bags)) < len(tags)
            for _, i, j in bags:
                mine, times = np.unique(back[i:j], return_counts=True)
                k = n[mine]
                at = np.repeat(begin[mine], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                b, where = np.unique(bucket[at], return_inverse=True)
                rows.append((b.astype(np.int32), np.bincount(where, np.repeat(np.sqrt(times), k)).astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[0] for b in bags], pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array(whole)], ["label", "buckets", "counts", "whole"])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, bool]], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) of a fitted model; rows: (label, buckets, counts, whole text or piece of one)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    soft = np.zeros((DIM, 2), np.float32)
    soft[:, 1] = rng.uniform(-1, 1, DIM)
    bias = np.zeros(2, np.float32)
    y = np.array([r[0] for r in rows], np.int64)
    share = np.bincount(y, minlength=2)
    if not share.all():
        return np.zeros(BUCKETS, np.float32), float(np.log((share[1] + 0.5) / (share[0] + 0.5))) if len(y) else -4.0
    # an empty text is clean: the bias alone must not say otherwise
    rows = [*rows, *[(0, np.zeros(0, np.int32), np.zeros(0, np.float32), True)] * (len(rows) // 20 + 1)]
    y = np.array([r[0] for r in rows], np.int64)
    share = np.bincount(y, minlength=2)
    seen = np.zeros(BUCKETS, np.int64)
    for _, b, _, whole in rows:
        if whole:
            seen[b] += 1
    known = seen >= LEAST_TEXTS
    # either class weighs half
    weight = (len(y) / 2 / share)[y]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("v", vectors), ("s", soft), ("b", bias))}
    step = 0

    def adam(key, value, grad, rate):
        m, s = state[key]
        m *= 0.9
        m += 0.1 * grad
        s *= 0.99
        s += 0.01 * grad * grad
        value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)

    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.02 * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            mine = order[lo:lo + BATCH]
            used = [rows[i] for i in mine]
            size = np.array([len(r[1]) for r in used])
            doc = np.repeat(np.arange(len(mine)), size)
            bucket = np.concatenate([r[1] for r in used]) if len(used) else np.zeros(0, np.int32)
            x = np.concatenate([r[2] / max(1.0, float(r[2].sum())) for r in used]).astype(np.float32) * known[bucket]
            mean = np.stack([np.bincount(doc, x * vectors[bucket, d], len(mine)) for d in range(DIM)], 1)
            logits = SCALE * mean @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            delta = p.copy()
            delta[np.arange(len(mine)), y[mine]] -= 1
            delta *= weight[mine][:, None] / len(mine)
            step += 1
            back = SCALE * delta @ soft.T
            touched, where = np.unique(bucket, return_inverse=True)
            grad = np.stack([np.bincount(where, x * back[doc, d]) for d in range(DIM)], 1).astype(np.float32)
            grad += DECAY * vectors[touched]
            grad[~known[touched]] = 0
            m, s = state["v"]
            m[touched] = 0.9 * m[touched] + 0.1 * grad
            s[touched] = 0.99 * s[touched] + 0.01 * grad * grad
            vectors[touched] -= rate * m[touched] / (np.sqrt(s[touched]) + 1e-6)
            adam("s", soft, (SCALE * mean.T @ delta).astype(np.float32), rate)
            adam("b", bias, delta.sum(0).astype(np.float32), rate)
    return np.where(known, SCALE * vectors @ (soft[:, 1] - soft[:, 0]), 0).astype(np.float32), float(bias[1] - bias[0])


def _fit_batches(batches):
    """All bags of the sample -> one row with the model."""
    rows = []
    for batch in batches:
        for label, b, c, whole in zip(batch.column("label").to_pylist(), batch.column("buckets"), batch.column("counts"),
                                      batch.column("whole").to_pylist(), strict=True):
            rows.append((label, b.values.to_numpy(), c.values.to_numpy(), whole))
    weights, bias = fit(rows)
    del rows
    release()
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()),
                                      pa.array([bias], pa.float64())], ["weights", "bias"])


def _score_batches(model):
    def run(batches):
        raw, bias = model.value
        weights = np.frombuffer(raw, np.float32).astype(np.float64)
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for lo, hi, data, offsets in W.slices(W.strings(batch.column("text"), lower=True), SCORED_BYTES):
                starts, ends, back, first = _distinct(data, offsets)
                bucket, owner = _subwords(data, starts, ends)
                value = np.bincount(owner, weights[bucket], len(starts))
                number = np.bincount(owner, minlength=len(starts))
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                pairs, times = np.unique(text * max(1, len(starts)) + back, return_counts=True)
                word, text = pairs % max(1, len(starts)), pairs // max(1, len(starts))
                times = np.sqrt(times)
                top = np.bincount(text, times * value[word], hi - lo)
                low = np.bincount(text, times * number[word], hi - lo)
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(top / np.maximum(low, 1) + bias, -60, 60)))
            # the text itself goes no further
            names = [f for f in batch.schema.names if f != "text"]
            release()
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in names], pa.array(scores)], [*names, "score"])
    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> tuple[bytes, float]:
    """The model for :func:`score`, from labelled documents whose crc32 of the id has a remainder by 5 other than 0.

    Rows without an id, text or label 0/1 are not learned from, nor are ids that have both labels. Of a
    repeated id the smallest text counts. Without rows of both labels every text gets one score.
    """
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
             .where("label = top").select("doc_id", "label"))
    there = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"))
    known = known.join(there, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    few = chosen[0].unionByName(chosen[1])
    texts = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
             .where("text IS NOT NULL").join(F.broadcast(few), "doc_id")  # at most 2 * sample rows
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")))
    bags = texts.orderBy(*order).mapInArrow(tidy(_bags), "label int, buckets array<int>, counts array<float>, whole boolean")
    row = bags.coalesce(1).mapInArrow(tidy(_fit_batches), "weights binary, bias double").first()
    return bytes(row["weights"]), row["bias"]


def score(docs: DataFrame, model: tuple[bytes, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): how likely each whole text is toxic, from 0 to 1; predicted 1 from 0.5 on.

    Null and empty texts get the score of an empty mean. Repeated rows repeat; an empty table gives
    none; ids may be null; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(tidy(_score_batches(held)), f"doc_id {kind}, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted); ``held_out`` ids (and null ids) are never learned from."""
    model = train(docs, labels, id_col, text_col)
    return (score(docs, model, id_col, text_col)
            .select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
                    "score", "predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted to be toxic."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col))
    names = docs.columns
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.mapInArrow(tidy(_clean_batches(held, text_col)), kinds)


def _clean_batches(model, text_col: str):
    scored = _score_batches(model)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col))], ["text"])
            good = np.concatenate([b.column("score").to_numpy() < 0.5 for b in scored([text])])
            yield batch.filter(pa.array(good))
    return run
