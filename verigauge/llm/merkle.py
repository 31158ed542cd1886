"""Merkle manifest of a table: a tree of 8-ary nodes per group, one tree over the groups, proofs for every row.

A leaf is the SHA-256 of a row's fields, a node that of its run's hex digests. Leaves get their place in the group
from range partitions and offsets. They are then kept in *leaf partitions*, aligned runs of ``RUN``
consecutive leaves of a group, each one row with arrays; Spark derives the nodes above them in rounds, ``RUN``
to one, so that even a group with most of the rows needs a logarithm of rounds and no large task.

Proofs come as an octopus multiproof: a leaf partition computes the smallest set of node coordinates that it can't
derive from its own leaves but that the proofs of all its leaves need together, fetches those nodes in one join,
derives the interior nodes that its proofs share once, and expands the individual proofs locally. A
tampered leaf is folded with the original siblings.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.llm.store import kept, shared
from verigauge.operators.ranks import ranked

FANOUT = 8
#: Levels between a leaf partition and its root, and so between the rounds of the tree.
STEP = 3
RUN = FANOUT ** STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Coordinate name of the tree over the groups' roots; groups themselves begin with 0 (null) or 1.
TOP = "2"


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _parents(nodes: str) -> Column:
    """The nodes above a column of consecutive nodes that begins at a run."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")),
        lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))


def _raised(runs: DataFrame) -> DataFrame:
    """``h1`` to ``h3``: the levels above the nodes ``h0`` of a run, each one a projection of its own."""
    for k in range(1, STEP + 1):
        runs = runs.withColumn(f"h{k}", _parents(f"h{k - 1}"))
    return runs


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves: a lone leaf is its own root."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def siblings(level: int, index: int, n: int) -> list[int]:
    """The other nodes of the run of a node, in a tree of n leaves."""
    width = -(-n // FANOUT ** level)
    first = index // FANOUT * FANOUT
    return [i for i in range(first, min(first + FANOUT, width)) if i != index]


def missing(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """The smallest union of (level, index) that the proofs of leaves lo to hi (end exclusive) of n need besides these leaves.

    On every level the known nodes are those above the leaves; of the runs they stand in, only what lies left of the
    first and right of the last known node is missing, everything between can be derived.
    """
    out = []
    last = hi - 1
    for level in range(height(n)):
        width = -(-n // FANOUT ** level)
        begin, end = lo // FANOUT * FANOUT, min(last // FANOUT * FANOUT + FANOUT, width)
        out += [(level, i) for i in range(begin, lo)] + [(level, i) for i in range(last + 1, end)]
        lo, last = lo // FANOUT, last // FANOUT
    return out


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def derive(leaves: list[str], lo: int, n: int, fetched: dict[tuple[int, int], str]) -> dict[tuple[int, int], str]:
    """All nodes on the paths of consecutive leaves from ``lo`` on, and the fetched ones, by coordinates."""
    nodes = dict(fetched)
    nodes.update(((0, lo + i), x) for i, x in enumerate(leaves))
    last = lo + len(leaves) - 1
    for level in range(height(n)):
        width = -(-n // FANOUT ** level)
        for run in range(lo // FANOUT, last // FANOUT + 1):
            nodes[level + 1, run] = _hash([nodes[level, i] for i in range(run * FANOUT, min(run * FANOUT + FANOUT, width))])
        lo, last = lo // FANOUT, last // FANOUT
    return nodes


def path(index: int, n: int) -> list[tuple[int, int, list[int]]]:
    """(level, index, siblings) of the nodes from a leaf up to below the root."""
    return [(level, index // FANOUT ** level, siblings(level, index // FANOUT ** level, n)) for level in range(height(n))]


def fold(leaf: str, places: list[int], siblings_up: list[list[str]]) -> str:
    """The root that a leaf gives, with its place in the run and the siblings of every level."""
    for place, others in zip(places, siblings_up, strict=True):
        leaf = _hash([*others[:place], leaf, *others[place:]])
    return leaf


def _wanted(batches):
    """A row per leaf partition -> a row per coordinate it misses, in its group's tree and in the one over the groups."""
    for batch in batches:
        block, group, level, index, tree = [], [], [], [], []
        for g, b, n, rank, groups in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "n", "rank", "groups")), strict=True):
            lo = b * RUN
            need = [(g, *x) for x in missing(lo, min(lo + RUN, n), n)] + [(TOP, *x) for x in missing(rank, rank + 1, groups)]
            for t, lev, i in need:
                block.append(b)
                group.append(g)
                tree.append(t)
                level.append(lev)
                index.append(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array(group, pa.string()), pa.array(block, pa.int64()), pa.array(tree, pa.string()), pa.array(level, pa.int32()),
             pa.array(index, pa.int64())], ["grp", "block", "tree", "level", "idx"])


PROOF = "doc_id long, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"


def _expand(with_proof: bool):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield _expanded({c: batch.column(c)[row].as_py() for c in batch.schema.names}, with_proof)
    return run


def _expanded(at: dict, with_proof: bool) -> pa.RecordBatch:
    """The rows of one leaf partition with their proofs; what the proofs share is derived once."""
    n, lo, rank, groups = at["n"], at["block"] * RUN, at["rank"], at["groups"]
    leaves = [x["leaf"] for x in at["leaves"]]
    mine = {(x["level"], x["idx"]): x["hash"] for x in at["fetched"] or () if x["tree"] != TOP}
    above = {(x["level"], x["idx"]): x["hash"] for x in at["fetched"] or () if x["tree"] == TOP}
    nodes = derive(leaves, lo, n, mine)
    subroot = nodes[height(n), 0]
    top = derive([subroot], rank, groups, above)
    root = top[height(groups), 0]
    up = [[top[level, s] for s in sib] for level, _, sib in path(rank, groups)]
    # (siblings of every level, place in every run, proof) from a node to the root
    tails = {(height(n), 0): (up, [i % FANOUT for _, i, _ in path(rank, groups)], "".join("".join(s) for s in up))}
    for level in range(height(n) - 1, -1, -1):
        step = FANOUT ** level
        for i in range(lo // step, (lo + len(leaves) - 1) // step + 1):
            others = [nodes[level, s] for s in siblings(level, i, n)]
            up, places, proof = tails[level + 1, i // FANOUT]
            tails[level, i] = [others, *up], [i % FANOUT, *places], "".join(others) + proof
    ids, proofs, sums, folded = [], [], [], []
    for k, x in enumerate(at["leaves"]):
        up, places, proof = tails[0, lo + k]
        ids.append(x["doc_id"])
        proofs.append(proof if with_proof else None)
        sums.append(hashlib.sha256(proof.encode()).hexdigest())
        folded.append(root if x["forged"] is None else fold(x["forged"], places, up))
    k = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(leaves), pa.array([subroot] * k), pa.array([root] * k), pa.array(proofs, pa.string()),
         pa.array(sums), pa.array(folded), pa.array([f == root for f in folded])],
        ["doc_id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])


def _sorted(place: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value])


def _tree(nodes: DataFrame, level: int, n_most: int) -> DataFrame:
    """(tree, level, idx, hash): the nodes (tree, idx, n, hash) of a level of trees with n leaves, and all above them."""
    made = [nodes.select("tree", F.lit(level).alias("level"), "idx", "hash")]
    while n_most > FANOUT ** level:
        runs = kept(_raised(nodes.where(F.col("n") > FANOUT ** level).groupBy("tree", F.floor(F.col("idx") / RUN).alias("run"))
                            .agg(F.first("n").alias("n"), _sorted("idx", "hash").alias("h0"))))
        for k in range(1, STEP + 1):
            # a tree that is no higher than this level ends in its root
            nodes = (runs.where(F.col("n") > FANOUT ** (level + k - 1)).select("tree", "n", "run", F.posexplode(f"h{k}").alias("pos", "hash"))
                     .select("tree", (F.col("run") * FANOUT ** (STEP - k) + F.col("pos")).alias("idx"), "n", "hash"))
            made.append(nodes.select("tree", F.lit(level + k).alias("level"), "idx", "hash"))
        level += STEP
    return kept(reduce(DataFrame.unionByName, made))


def _height(n: Column) -> Column:
    """As :func:`height`; no table has 8 ** 20 rows."""
    return sum(((n > FANOUT ** k).cast("int") for k in range(1, 20)), (n > 1).cast("int"))


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text",
             with_proof: bool = True) -> DataFrame:
    """A row per row of ``docs``: leaf, its group's root, the root, the proof (hex digests of the siblings, level by level
    up to the root, left to right), its SHA-256, the root folded from the row as found, and whether that is the root.

    Rows whose id has a crc32 (of its decimal digits) that 3 divides are tampered with: their text's A-Z are lower-cased;
    a null text stays, and a text without such letters gives the same leaf and is verified.
    Null fields are ``-``. A null group is a group of its own, before all others; groups go by their UTF-8
    bytes. A null id comes first in its group and is not tampered with (it has no digits). Rows that share an id
    go by their leaf hash; equal rows are leaves of their own and differ in their proofs only. An empty
    table gives no rows. ``doc_id`` must be an integer; other columns are not looked at.
    """
    shared(docs.sparkSession)
    plain = [F.col(f"`{c}`") for c in fields]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bent = [F.translate(c.cast("string"), letters, letters.lower()) if name == text_col else c for name, c in zip(fields, plain, strict=True)]
    doc_id, group = F.col(f"`{id_col}`").cast("long"), F.col(f"`{group_col}`").cast("string")
    slim = docs.select(
        F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("grp"), doc_id.alias("doc_id"), leaf_hash(*plain).alias("leaf"),
        F.when(F.crc32(doc_id.cast("string")) % 3 == 0, leaf_hash(*bent)).alias("forged"))
    # hashed once: finding the ranges reads the table a second time
    placed = ranked(kept(slim), ["grp"], ["doc_id", "leaf"], "idx", "n")
    runs = _raised(placed.groupBy("grp", F.floor(F.col("idx") / RUN).alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "doc_id", "leaf", "forged"))).alias("leaves"))
        .withColumn("h0", F.transform("leaves", lambda x: x["leaf"])))
    here = F.coalesce(*[F.when(F.col("n") <= FANOUT ** k, F.element_at(f"h{k}", 1)) for k in range(STEP)], F.element_at(f"h{STEP}", 1))
    blocks = kept(runs.select("grp", "block", "n", "leaves", here.alias("hash")))
    large = blocks.where(F.col("n") > RUN).select(F.col("grp").alias("tree"), F.col("block").alias("idx"), "n", "hash")
    nodes = _tree(large, STEP, blocks.agg(F.max("n")).first()[0] or 1)
    high = large.where("idx = 0").select("tree", _height(F.col("n")).alias("level")).join(nodes.where("idx = 0"), ["tree", "level"])
    roots = blocks.where(F.col("n") <= RUN).select("grp", "hash").unionByName(high.select(F.col("tree").alias("grp"), "hash"))
    # the groups' roots are the leaves of one more tree
    roots = kept(ranked(roots.withColumn("tree", F.lit(TOP)), ["tree"], ["grp"], "rank", "groups"))
    top = _tree(roots.select("tree", F.col("rank").alias("idx"), F.col("groups").alias("n"), "hash"), 0, roots.agg(F.max("groups")).first()[0] or 1)
    located = kept(blocks.join(roots.select("grp", "rank", "groups"), "grp").drop("hash"))
    wanted = located.select("grp", "block", "n", "rank", "groups").mapInArrow(
        _wanted, "grp string, block long, tree string, level int, idx long")
    fetched = (wanted.join(nodes.unionByName(top), ["tree", "level", "idx"]).groupBy("grp", "block")
               .agg(F.collect_list(F.struct("tree", "level", "idx", "hash")).alias("fetched")))
    found = located.join(fetched, ["grp", "block"], "left").mapInArrow(_expand(with_proof), PROOF)
    return found if with_proof else found.drop("proof")
