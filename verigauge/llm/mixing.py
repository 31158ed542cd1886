"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash, a source into as many as its own words and rows ask for. One aggregation
gives the words of every block. A source's target is met by whole passes over its blocks and a random part of them: blocks in a
permuted order, passing over those that no longer fit; what is then left comes from documents of the blocks passed over, in hash order
and passing over those that no longer fit. These quotas of blocks are then split among the output shards by a tree: the number of
blocks that goes to the left half of the shards is drawn, for many sources together, from the multivariate hypergeometric
distribution, and so on down to single shards. So every quota is met exactly and every shard is a random mix. Each shard draws
the next blocks of each source's permutation, so no two shards draw the same one, and shuffles its rows by hash.

Sources are numbered, given their targets and planned by Spark: one task draws the trees of ``SOURCES_AT_ONCE`` sources, and the
driver sees sums only. There are about ``PLAN_BLOCKS`` blocks, and one more for each source. Ids, hashes and sizes are stored
once for the plan; texts only move for the last, local shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm.store import kept, unused
from verigauge.operators.ranks import ranked

#: Fixed values of the contract: weights of the sources in turn, words to take in all, passes at most.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
PASSES = 2.0

#: Blocks of all sources together, and words and rows that a block has at least on average.
PLAN_BLOCKS = 1 << 16
LEAST_BLOCK = 1024
SOURCES_AT_ONCE = 64
#: Words in one output shard; there are never more shards than ``PLAN_BLOCKS`` or blocks.
SHARD_WORDS = 1 << 22
SEED = 20240917


def words_in(text):
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights, total: float, passes: float) -> DataFrame:
    """``sources`` (k, words, ...) with ``target``: by weight, none above ``passes`` times its words; the excess goes to the others by weight.

    The level at which sources stop rises from round to round; a round is one aggregation to a row per weight.
    Sums are taken over whole numbers, so the order of rows does not matter.
    """
    turn = F.col("k") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    most = F.lit(float(passes)) * F.col("words")
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else F.lit(level) * weight >= most
        rows = (sources.groupBy(turn.alias("turn"))
                .agg(F.count_if(~full).alias("open"), F.count_if(full).alias("full"),
                     F.sum(F.when(full, F.col("words")).otherwise(0)).alias("words")).collect())
        rows = [r for r in rows if weights[r["turn"]] > 0]
        now, rest = sum(r["full"] for r in rows), total - passes * sum(r["words"] for r in rows)
        open_ = sum(float(weights[r["turn"]]) * r["open"] for r in sorted(rows))
        if now == stopped or not open_:
            break
        stopped, level = (now if level is not None else -1), rest / open_
    level = F.lit(float(level or 0))
    return sources.withColumn("target", F.when(weight <= 0, F.lit(0.0)).when(level * weight >= most, most).otherwise(level * weight))


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): quotas dealt out by the splitting tree; every column adds up to its quota."""
    out = np.zeros((shards, len(quotas)), np.int64)
    work = [(0, shards, quotas.astype(np.int64))]
    while work:
        lo, hi, have = work.pop()
        n = int(have.sum())
        if hi - lo == 1 or not n:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(have, n * (mid - lo) // (hi - lo), method="marginals")
        work += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _draws(blocks: np.ndarray, classes: np.ndarray, words: np.ndarray, target: float, rng: np.random.Generator):
    """(blocks drawn in turn, those of them to be cut, words to take from these): sorted rows (block, class, words) of one source.

    Class c holds documents of 2^(c-1) to 2^c - 1 words. Cut blocks are those passed over, as many as have enough documents that fit.
    """
    own, first = np.unique(blocks, return_index=True)
    sums = np.add.reduceat(words, first)
    size, left = int(sums.sum()), float(target)
    if not size:
        return [], [], 0
    drawn: list[int] = []
    while left >= size:
        drawn += own[rng.permutation(len(own))].tolist()
        left -= size
    over = []
    for i in rng.permutation(len(own)).tolist():
        if sums[i] <= left:
            drawn.append(int(own[i]))
            left -= int(sums[i])
        else:
            over.append(i)
    rest = int(round(left))
    if not rest:
        return drawn, [], 0
    fits = np.add.reduceat(np.where((1 << classes) - 1 <= rest, words, 0), first)
    least = np.minimum.reduceat(np.where(classes > 0, classes, 64), first)
    cut, have = [], 0
    for i in over:
        if fits[i] and have < rest:
            cut.append(i)
            have += int(fits[i])
    if have < rest:
        # the nearest miss may be a document a little too long
        near = min((i for i in over), key=lambda i: least[i])
        cut += [near] if near not in cut else []
    return drawn, [int(own[i]) for i in cut], rest


def _plan_group(shards: int, seed: int):
    """Rows (at_once, k, block, class, words, target) of some sources -> (k, block, all, some, part)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "block", "class"])
        ks, first = np.unique(rows["k"].to_numpy(), return_index=True)
        edges = [*first.tolist(), len(rows)]
        block, kind, words, target = (rows[c].to_numpy() for c in ("block", "class", "words", "target"))
        draws = []
        for n, k in enumerate(ks.tolist()):
            at = slice(edges[n], edges[n + 1])
            draws.append(_draws(block[at], kind[at], words[at], float(target[edges[n]]), np.random.default_rng([seed, k])))
        rng = np.random.default_rng([seed, int(ks[0]) // SOURCES_AT_ONCE, len(ks)])
        dealt = split(np.array([len(d) + len(c) for d, c, _ in draws], np.int64), shards, rng)
        # quotas too small for all shards end at the right of their part of the tree: another place for every group
        turned = int(rng.integers(shards))
        out: dict = {}
        for n, (k, (drawn, cut, rest)) in enumerate(zip(ks.tolist(), draws, strict=True)):
            spots = (np.repeat(np.arange(shards), dealt[:, n]) + turned) % shards
            for b, shard in zip(drawn, spots[:len(drawn)].tolist(), strict=True):
                out.setdefault((k, b), [[], None, None])[0].append(shard)
            for b, shard in zip(cut, spots[len(drawn):].tolist(), strict=True):
                out.setdefault((k, b), [[], None, None])[1:] = [shard, rest]
        keys = sorted(out)
        return pd.DataFrame({"k": [x for x, _ in keys], "block": [b for _, b in keys], "all": [sorted(out[x][0]) for x in keys],
                             "some": pd.array([out[x][1] for x in keys], "Int32"), "part": pd.array([out[x][2] for x in keys], "Int64")})
    return run


def _fill_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (k, spot, size, n, turn, part) of the cut blocks of a source -> (k, spot, size, n, take): documents in hash order while they fit."""
    rows = rows.sort_values(["turn", "spot", "size"])
    left = int(rows["part"].iloc[0])
    sizes, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    take = np.where(sizes == 0, counts, 0)
    for i in np.flatnonzero((sizes > 0) & (sizes <= left)).tolist():
        m = min(int(counts[i]), left // int(sizes[i]))
        take[i] = m
        left -= m * int(sizes[i])
        if not left:
            break
    over = np.flatnonzero((sizes > 0) & (take < counts))
    if left and len(over):
        i = over[np.argmin(sizes[over])]
        take[i] += sizes[i] < 2 * left
    return rows[["k", "spot", "size", "n"]].assign(take=take)


def added(docs: DataFrame) -> list[str]:
    """The columns that :func:`mix` adds to ``docs``: ``_size, _source_size, _target, _shards, _spot`` or, where taken, free names."""
    return unused(docs, "_size", "_source_size", "_target", "_shards", "_spot")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = SHARE, passes: float = PASSES, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_shards``: the shards that get the row, once each.

    ``_size`` is the number of words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0). Sources in code point order, null last,
    take ``weights`` in turn and share ``share`` times all words; no row is drawn more than ``passes`` times
    (rounded up). The words taken of a source miss its target by less than half the smallest document that could still be taken.
    A row of no words is drawn with its block. Equal rows share a block and are separate rows of the mix; ids may be null.
    The same table and seed give the same mix. An empty table gives no rows. Other columns pass through; where
    one of them has the name of a new column, the new one gets the name that :func:`added` tells.
    """
    size, source_size, target, shards_of, spot = added(docs)
    k, block, name, blocks, all_, some, place, rows_alike, take, n = unused(
        docs, "_k", "_block", "_name", "_blocks", "_all", "_some", "_place", "_alike", "_take", "_n")
    source = F.col(source_col).cast("string")
    where = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    slim = kept(docs.select(source.alias("source"), where.alias("spot"), words_in(F.col(text_col)).alias("size")))
    sources = kept(slim.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    words, rows = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    unit = max(LEAST_BLOCK, -(-(words + rows) // PLAN_BLOCKS))
    sources = kept(ranked(sources, [], [F.col("source").asc_nulls_last()], "k", "of")
                   .withColumn("blocks", F.ceil((F.col("words") + F.col("rows")) / unit)))
    if shards is None:
        shards = max(1, min(PLAN_BLOCKS, -(-int(share * words) // SHARD_WORDS), -(-(words + rows) // unit)))
    goals = kept(with_targets(sources, weights, share * words, passes))

    near = slim.join(goals.select(F.col("source").alias("name"), "k", "blocks", "target"), F.col("source").eqNullSafe(F.col("name")))
    near = near.select("k", F.pmod("spot", "blocks").alias("block"), "spot", "size", "target")
    kind = F.when(F.col("size") == 0, 0).otherwise(F.length(F.bin("size"))).alias("class")
    sums = near.groupBy("k", "block", kind).agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    plan = kept(sums.groupBy(F.floor(F.col("k") / SOURCES_AT_ONCE).alias("at_once"))
                .applyInPandas(lambda rows: _plan_group(shards, seed)(rows), "k long, block long, all array<int>, some int, part long"))
    cut = (near.join(plan.where("some IS NOT NULL").select("k", "block", "part"), ["k", "block"])
           .groupBy("k", "spot", "size", "part").agg(F.count("*").alias("n")).withColumn("turn", F.xxhash64("spot", "size")))
    fills = kept(cut.groupBy("k").applyInPandas(_fill_source, "k long, spot long, size long, n long, take long").where("take > 0"))

    found = (docs.withColumns({size: words_in(F.col(text_col)), spot: where})
             .join(goals.select(F.col("source").alias(name), F.col("k").alias(k), F.col("blocks").alias(blocks),
                                F.col("words").alias(source_size), F.col("target").alias(target)), source.eqNullSafe(F.col(name)))
             .withColumn(block, F.pmod(spot, blocks))
             .join(plan.select(F.col("k").alias(k), F.col("block").alias(block), F.col("all").alias(all_), F.col("some").alias(some)),
                   [k, block], "left")
             .join(fills.toDF(k, spot, size, n, take), [k, spot, size], "left")
             .withColumn(all_, F.coalesce(all_, F.array().cast("array<int>"))))
    names = [*[F.col(f"`{c}`") for c in docs.columns], F.col(size), source_size, target, F.col(all_).alias(shards_of), F.col(spot)]
    more = F.concat(all_, F.array(some))
    if fills.where("take < n").isEmpty():
        return found.withColumn(all_, F.when(F.col(take).isNotNull(), more).otherwise(F.col(all_))).select(names)
    # some of several equal rows: numbered without a window over them
    some_alike = F.coalesce(F.col(take) < F.col(n), F.lit(False))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    alike = ranked(kept(found.where(some_alike)), [k, spot, size], [F.xxhash64(*plain)], place, rows_alike)
    return (found.where(~some_alike).withColumn(all_, F.when(F.col(take).isNotNull(), more).otherwise(F.col(all_))).select(names)
            .unionByName(alike.withColumn(all_, F.when(F.col(place) < F.col(take), more).otherwise(F.col(all_))).select(names)))


def shuffled(mixed: DataFrame, columns: list[str], shards: str = "_shards", spot: str = "_spot") -> DataFrame:
    """The rows of a mix, one per draw: every shard together in one partition, in random order inside."""
    turn, shard = unused(mixed, "_turn", "_shard")
    names = [F.col(f"`{c}`") for c in columns]
    drawn = mixed.select(*names, spot, F.posexplode(shards).alias(turn, shard))
    return drawn.repartition(F.col(shard)).sortWithinPartitions(shard, F.xxhash64(spot, shard, turn)).select(*names)
