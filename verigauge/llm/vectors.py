"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, connected components.

Each table hashes a vector to the signs of its products with random hyperplanes. Vectors are compared when label, length and
all signs of one table are equal. Bits and tables follow from the number of vectors, so that a bucket of unrelated
vectors stays small, and from the wanted recall: a pair at the threshold agrees in a bit with probability
1 - angle / pi, hence the number of tables that leaves at most ``1 - RECALL`` of such pairs apart.

Equal vectors count as one with a weight. A bucket is compared by matrix products in blocks; a crowded one becomes a grid
of blocks for many tasks. A block returns a row per vector: the weight it links to, counted only in the first table that
two vectors share, and the root of its part of the block. Pairs are never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm.graphs import components
from verigauge.llm.store import kept

THRESHOLD = 0.93
RECALL = 0.9995
#: Unrelated vectors that share a bucket on average.
COMPANY = 64
#: Vectors on either side of a block.
BLOCK = 1024
SEED = 11


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors under one label."""
    bits = max(4, math.ceil(math.log2(max(2, n / COMPANY))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _clean_batches(batches):
    """Vectors as bytes of doubles; null where a vector cannot link."""
    for batch in batches:
        lists = batch.column("vec")
        if isinstance(lists, pa.LargeListArray):
            lists = lists.cast(pa.list_(lists.type.value_type))
        out = []
        for x in lists:
            v = None if x.values is None or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            good = v is not None and len(v) and np.isfinite(v).all() and v.any()
            out.append(v.tobytes() if good else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])


def unit(raw: list[bytes]) -> np.ndarray:
    v = np.stack([np.frombuffer(x, np.float64) for x in raw])
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _sign_batches(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        powers = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            raw = batch.column("vec").to_pylist()
            size = np.array([len(x) // 8 for x in raw])
            sigs = np.zeros((len(raw), tables), np.int64)
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), bits * tables))
                signs = (unit([raw[i] for i in mine]) @ planes[d] > 0).reshape(len(mine), tables, bits)
                sigs[mine] = (signs * powers).sum(2)
            flat = pa.ListArray.from_arrays(np.arange(0, sigs.size + 1, tables, dtype=np.int32), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("node", "label", "w", "vec")], pa.array(size, pa.int32()), flat],
                ["node", "label", "w", "vec", "dim", "sigs"])
    return run


def _compare(key: tuple, block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(node, links, root) of a block: its rows of side 0 against those of side 1, or all pairs of side 0."""
    turn = int(key[2])
    block = block.sort_values(["side", "node"], kind="stable")
    v, node, w = unit(block["vec"].tolist()), block["node"].to_numpy(), block["w"].to_numpy()
    sigs = np.stack(block["sigs"].to_numpy())
    q = int((block["side"] == 0).sum())
    own = q == len(block)
    cos = v[:q] @ (v if own else v[q:]).T
    i, j = np.nonzero(cos >= threshold - 1e-12)
    near = cos[i, j] < threshold + 1e-12
    j = j if own else j + q
    if near.any():
        raw = np.stack([np.frombuffer(x, np.float64) for x in block["vec"]])
        a, b = raw[i[near]], raw[j[near]]
        exact = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        keep = np.ones(len(i), bool)
        keep[np.flatnonzero(near)[exact < threshold]] = False
        i, j = i[keep], j[keep]
    if own:
        i, j = i[i < j], j[i < j]
    first = ~(sigs[i, :turn] == sigs[j, :turn]).any(1) if turn else np.ones(len(i), bool)
    links = np.bincount(i[first], w[j[first]], len(node)) + np.bincount(j[first], w[i[first]], len(node))
    root = np.arange(len(node))
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    used = (links > 0) | (root != np.arange(len(node)))
    return pd.DataFrame({"node": node[used], "links": links[used].astype(np.int64), "root": node[root[used]]})


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link if labels are equal and not null, lengths are equal and their cosine, in double precision, is at least
    ``threshold``. Null, empty and zero vectors and those with null or non-finite components link with nothing:
    they are a component by themselves. Repeated rows are vectors of their own and link with each other.
    A component is named by its smallest id that is not null. An empty table gives no rows; other
    columns are not looked at.
    """
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    base = kept(base.mapInArrow(_clean_batches, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary")
                .withColumn("row", F.monotonically_increasing_id()))
    able = base.where("vec IS NOT NULL AND label IS NOT NULL")
    reps = kept(able.groupBy("label", "vec").agg(F.min("row").alias("node"), F.count("*").alias("w"), F.min("vec_id").alias("least")))
    most = able.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    bits, tables = tables_for(most, threshold, recall)
    signed = kept(reps.select("node", "label", "w", "vec").mapInArrow(
        _sign_batches(bits, tables), f"node long, label {kinds['label']}, w long, vec binary, dim int, sigs array<long>"))
    rows = signed.select("*", F.posexplode("sigs").alias("turn", "sig"))
    key = ["label", "dim", "turn", "sig"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n"))
    crowded = kept(sizes.where(F.col("n") > BLOCK).select(*key, F.ceil(F.col("n") / BLOCK).alias("nb")))
    placed = rows.join(crowded, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("long")))
    mine = F.pmod(F.xxhash64("node"), F.col("nb"))
    # block b meets every other block once: as side 0 of those behind it, as side 1 of those before
    dealt = placed.withColumn("b", mine).select(
        *key, "node", "w", "vec", "sigs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o"), "b").select(
        *key, "node", "w", "vec", "sigs", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"),
        (F.col("b") > F.col("o")).cast("int").alias("side"))
    found = kept(dealt.groupBy(*key, "i", "j").applyInPandas(lambda key, block: _compare(key, block, threshold), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select("node", "root"), "node", "root")
    named = (reps.select("label", "vec", "node", "w", "least").join(links, "node", "left").join(parts, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    done = base.join(named, ["label", "vec"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                       component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
