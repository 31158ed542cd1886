"""Conversation repair: a cost DP over the turns, then the least of the cheapest edits by prefix doubling.

Rows of a conversation are numbered by range partitions and offsets and kept in chunks of ``CHUNK`` turns, one
row with arrays each, so that a conversation of any length is spread. A chunk's DP is a 4 x 4 matrix of costs
between the states of the grammar of roles; products of matrices are associative, so the costs to the end behind every chunk come
from doubling rounds over the chunks, a logarithm of the longest conversation. Then every chunk ranks its
*optimal arcs* by prefix doubling: two arcs compare first by their letters, then by audits of 2, 4, 8 letters, every round a
rank of pairs (own rank, rank of the arc that the doubled pointer leads to). In a state the arc of least
rank is taken, and the path is read off through the doubled pointers. Which state a chunk begins in follows
from doubling again, this time over the chunks' maps of states.

Texts stay out of all this (hashes stand for them) and are joined to the turns that remain. SHA-256 is
sequential by nature, so the lines of one repaired conversation pass one task as a sorted stream; nothing is gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.llm.store import kept, shared
from verigauge.operators.ranks import ranked

CHUNK = 64
#: Chunks that are worked on at once.
AT_ONCE = 256
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLANKS = " \t\n\x0b\x0c\r"
#: States of the grammar: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end.
FAR = np.int64(1) << 60
#: The state after a reroled or inserted turn, a user's unless a user spoke last.
NEXT = np.array([2, 2, 3, 2])
ROLE = {2: "user", 3: "assistant"}
#: The state after a kept turn, by its initial (s, u, a, other); -1 where it can't stand.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Edits in the order of their letters.
LETTERS = b"DIKR"
OK, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Pairs of initials that may stand side by side: su, ua, au.
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32(`conv_id:turn`) % 20 brings; nulls are one space, in role and text and there."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    hit = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    made = rows.select(
        "conv_id", "turn", hit.alias("hit"), F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    twice = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return made.where("hit <> 0").withColumn("copy", twice).drop("hit", "copy")


def _numbered(rows: DataFrame) -> DataFrame:
    """(grp, idx, size, who, fault, role, body) of rows (grp, turn, role, text); ``body`` is the hash of the text."""
    text, one = F.col("text"), F.substring("role", 1, 1)
    last = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)
    look = F.when(F.length(F.trim(text, F.lit(BLANKS))) == 0, BLANK).when(last.isin(".", "!", "?"), OK).otherwise(CUT)
    who = F.when(one == "s", 0).when(one == "u", 1).when(one == "a", 2).otherwise(3)
    slim = kept(rows.select("grp", "turn", "role", F.unhex(F.md5("text")).alias("body"), who.cast("int").alias("who"), look.cast("int").alias("look")))
    placed = ranked(slim, ["grp"], ["turn", "role", "body"], "idx")
    first = placed.groupBy("grp", "role", "body").agg(F.min("idx").alias("first"))
    fault = F.when((F.col("look") != BLANK) & (F.col("idx") > F.col("first")), DUPLICATE).otherwise(F.col("look"))
    return placed.join(first, ["grp", "role", "body"]).select("grp", "idx", "size", "who", fault.cast("int").alias("fault"), "role", "body")


class Chunks:
    """Chunks as arrays [chunk, turn], padded in front, so that all end together."""

    def __init__(self, who: list, fault: list):
        self.sizes = np.array([len(x) for x in who])
        self.length = int(self.sizes.max(initial=0))
        shape = (len(who), self.length)
        self.who, self.fault, self.real = np.full(shape, 3), np.zeros(shape, int), np.zeros(shape, bool)
        for c, (w, f) in enumerate(zip(who, fault, strict=True)):
            at = self.length - len(w)
            self.who[c, at:], self.fault[c, at:], self.real[c, at:] = w, f, True

    def arcs(self, i: int, after: np.ndarray) -> np.ndarray:
        """Costs to the end [chunk, state, letter] of what consumes turn i; ``after``: costs behind it [chunk, state]."""
        out = np.full((*after.shape, 4), FAR)
        out[:, :, 0] = after + DELETE
        stays = (self.fault[:, i] == OK) | (self.fault[:, i] == CUT)
        extra = np.where(self.fault[:, i] == CUT, TRUNCATED, 0)[:, None]
        to = AFTER[:, self.who[:, i]].T
        out[:, :, 2] = np.where(stays[:, None] & (to >= 0), np.take_along_axis(after, np.maximum(to, 0), 1) + extra, FAR)
        out[:, :, 3] = np.where(stays[:, None], after[:, NEXT] + REROLE + extra, FAR)
        return out

    def costs(self, end: np.ndarray) -> np.ndarray:
        """Costs to the end [turn, chunk, state], from those behind the chunk."""
        out = np.empty((self.length + 1, *end.shape), np.int64)
        out[-1] = end
        for i in range(self.length - 1, -1, -1):
            here = inserted(self.arcs(i, out[i + 1]).min(axis=2))
            out[i] = np.minimum(np.where(self.real[:, i, None], here, out[i + 1]), FAR)
        return out

    def matrix(self) -> np.ndarray:
        """Costs of each chunk between states [chunk, from, to]; inserts stand before its turns."""
        n = len(self.sizes)
        return np.stack([self.costs(np.where(np.arange(4) == to, 0, FAR) * np.ones((n, 1), np.int64))[0] for to in range(4)], axis=2)

    def least(self, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The least of the cheapest audits [chunk, place] from the entry states: letters (-1 behind the end), the states after them, and
        the states behind the chunks, with the costs from the entry to the end."""
        n, length = len(self.sizes), self.length
        cost = self.costs(end)
        # optimal arcs [turn, chunk, state, letter] and the nodes they lead to; arcs that are not optimal rank behind all
        optimal = np.zeros((length, n, 4, 4), bool)
        to_turn = np.broadcast_to(np.arange(length)[:, None, None, None] + np.array([1, 0, 1, 1]), optimal.shape)
        to_state = np.empty(optimal.shape, np.int64)
        for i in range(length):
            arcs = self.arcs(i, cost[i + 1])
            arcs[:, :, 1] = cost[i][:, NEXT] + INSERT
            optimal[i] = (arcs == cost[i][:, :, None]) & (arcs < FAR) & self.real[:, i, None, None]
            to_state[i, :, :, 0], to_state[i, :, :, 1], to_state[i, :, :, 3] = np.arange(4), NEXT, NEXT
            to_state[i, :, :, 2] = AFTER[:, self.who[:, i]].T
        node = (to_turn * n + np.arange(n)[:, None, None]) * 4 + to_state
        # one letter: the first round. Behind the end every arc is the last one, which comes before all letters.
        total = optimal.size
        rank = np.append(np.where(optimal, np.arange(1, 5), 9).ravel(), 0)
        ways = rank[:-1].reshape(-1, 4)
        out_of = np.append(np.arange(len(ways)) * 4 + ways.argmin(axis=1), np.full(4 * n, total))
        pointer = np.append(np.where(optimal.ravel(), out_of[np.where(optimal, node, len(out_of) - 1).ravel()], total), total)
        doubled = []
        while True:
            doubled.append(pointer)
            if (pointer == total).all():
                break
            # audits of twice the length: pairs of ranks
            _, rank = np.unique(rank.astype(np.int64) * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
            pointer = pointer[pointer]
        start = ((length - self.sizes) * n + np.arange(n)) * 4 + entry
        best = rank[start[:, None] * 4 + np.arange(4)].argmin(axis=1)
        arcs = (start * 4 + best)[:, None]
        for pointer in doubled[:-1]:
            arcs = np.concatenate([arcs, pointer[arcs]], axis=1)
        live = arcs < total
        used = np.minimum(arcs, total - 1)
        letters = np.where(live, used % 4, -1)
        states = to_state.ravel()[used]
        last = states[np.arange(n), live.sum(axis=1) - 1]
        return letters, states, last, cost[length - self.sizes, np.arange(n), entry]


def inserted(costs: np.ndarray) -> np.ndarray:
    """Costs where inserts may come first."""
    for _ in range(3):
        costs = np.minimum(costs, costs[:, NEXT] + INSERT)
    return costs


#: Costs behind the last turn: inserts end an open exchange.
ENDS = inserted(np.array([[0, FAR, FAR, 0]]))[0]


def _slices(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(lo, AT_ONCE)
            rows = {c: part.column(c).to_pylist() for c in part.schema.names}
            yield part, rows, Chunks(rows["who"], rows["fault"])


def _matrices(batches):
    for part, _, chunks in _slices(batches):
        flat = np.minimum(chunks.matrix(), FAR).reshape(-1)
        yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("chunk"), pa.ListArray.from_arrays(
            np.arange(0, len(flat) + 1, 16, dtype=np.int32), pa.array(flat))], ["grp", "chunk", "m"])


def _maps(batches):
    """The state behind each chunk, for each state it may begin in; states that lead nowhere keep to themselves."""
    for part, rows, chunks in _slices(batches):
        end = np.array(rows["end"])
        out = [chunks.least(end, np.full(len(end), q))[2] for q in range(4)]
        yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("chunk"), pa.ListArray.from_arrays(
            np.arange(0, 4 * len(end) + 1, 4, dtype=np.int32), pa.array(np.stack(out, axis=1).reshape(-1)))], ["grp", "chunk", "m"])


_ITEM = "struct<idx: long, sub: int, role: string, old: string, body: binary>"
_DONE = (f"grp string, chunk long, audit string, blank long, duplicate long, truncated long, illegal long, head int, foot int, cost long, items array<{_ITEM}>")


def _edits(batches):
    """A row per chunk: its part of the audit, counts, the initials at its edges, and the turns that remain."""
    for part, rows, chunks in _slices(batches):
        letters, states, last, cost = chunks.least(np.array(rows["end"]), np.array(rows["entry"]))
        out = []
        for c in range(len(cost)):
            i, sub, items, audit = 0, 0, [], bytearray()
            base, size = rows["chunk"][c] * CHUNK, int(chunks.sizes[c])
            for letter, state in zip(letters[c].tolist(), states[c].tolist(), strict=True):
                if letter < 0:
                    break
                audit.append(LETTERS[letter])
                role, body = rows["role"][c][min(i, size - 1)], rows["body"][c][min(i, size - 1)]
                if letter == 1:
                    items.append({"idx": base + i, "sub": sub, "role": ROLE[state], "old": None, "body": None})
                    sub += 1
                    continue
                if letter >= 2:
                    items.append({"idx": base + i, "sub": sub, "role": role if letter == 2 else ROLE[state], "old": role, "body": body})
                i, sub = i + 1, 0
            if rows["chunk"][c] + 1 == rows["n_chunks"][c]:
                state = int(last[c])
                while state in (1, 2):
                    state = int(NEXT[state])
                    audit.append(LETTERS[1])
                    items.append({"idx": base + size, "sub": sub, "role": ROLE[state], "old": None, "body": None})
                    sub += 1
            who, fault = np.array(rows["who"][c]), np.array(rows["fault"][c])
            out.append({"grp": rows["grp"][c], "chunk": rows["chunk"][c], "audit": audit.decode(), "blank": int((fault == BLANK).sum()),
                        "duplicate": int((fault == DUPLICATE).sum()), "truncated": int((fault == CUT).sum()),
                        "illegal": int((~LEGAL[who[:-1], who[1:]]).sum()), "head": int(who[0]), "foot": int(who[-1]), "cost": int(cost[c]),
                        "items": items})
        yield pa.RecordBatch.from_pylist(out, _done_schema())


def _done_schema() -> pa.Schema:
    item = pa.struct([("idx", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("old", pa.string()), ("body", pa.binary())])
    return pa.schema([("grp", pa.string()), ("chunk", pa.int64()), ("audit", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
                      ("head", pa.int32()), ("foot", pa.int32()), ("cost", pa.int64()), ("items", pa.list_(item))])


def _product(a: str, b: str) -> Column:
    """The product of two matrices of costs."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.least(F.lit(int(FAR)), *[
        F.get(a, F.floor(i / 4).cast("int") * 4 + k) + F.get(b, i % 4 + 4 * k) for k in range(4)]))


def _doubled(chunks: DataFrame, n_most: int, forward: bool) -> DataFrame:
    """Products of matrices from each chunk to the last one, or maps of states from the first one to each, by doubling rounds."""
    step = 1
    while step < n_most:
        far = chunks.select(F.col("grp").alias("g"), (F.col("chunk") + (-step if forward else step)).alias("k"), F.col("m").alias("more"))
        both = F.transform("more", lambda q: F.get("m", q)) if not forward else _product("m", "more")
        chunks = kept(chunks.join(far, (F.col("grp") == F.col("g")) & (F.col("chunk") == F.col("k")), "left")
                      .select("grp", "chunk", F.when(F.col("more").isNull(), F.col("m")).otherwise(both).alias("m")))
        step *= 2
    return chunks


def _placed(chunks: DataFrame) -> DataFrame:
    """Chunks with the costs behind them (``end``) and the states they begin in (``entry``)."""
    ends = F.array(*[F.lit(int(x)) for x in ENDS])
    single = chunks.where("n_chunks = 1").withColumns({"end": ends, "entry": F.lit(0)})
    many = chunks.where("n_chunks > 1")
    n_most = many.agg(F.max("n_chunks")).first()[0]
    if n_most is None:
        return single
    slim = many.select("grp", "chunk", "n_chunks", "who", "fault")
    to_end = _doubled(kept(slim.mapInArrow(_matrices, "grp string, chunk long, m array<long>")), n_most, True)
    behind = to_end.select(F.col("grp").alias("g"), (F.col("chunk") - 1).alias("k"), F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda q: F.least(*[F.get("m", q * 4 + k) + F.lit(int(ENDS[k])) for k in range(4)])).alias("costs"))
    at = (F.col("grp") == F.col("g")) & (F.col("chunk") == F.col("k"))
    slim = kept(slim.join(behind, at, "left").select("grp", "chunk", "who", "fault", F.coalesce("costs", ends).alias("end")))
    maps = _doubled(kept(slim.mapInArrow(_maps, "grp string, chunk long, m array<long>")), n_most, False)
    before = maps.select(F.col("grp").alias("g"), (F.col("chunk") + 1).alias("k"), F.get("m", F.lit(0)).cast("int").alias("state"))
    state = slim.join(before, at, "left").select("grp", "chunk", "end", F.coalesce("state", F.lit(0)).alias("entry"))
    return single.unionByName(many.join(state, ["grp", "chunk"]))


_RESULT = "grp string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _streamed(batches):
    """Sorted rows of conversations, chunk heads (``sub`` -1) and lines -> a row per conversation."""
    now: dict | None = None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([now["grp"]]), *[pa.array([now[c]], pa.int64()) for c in (*_COUNTS, "cost")], pa.array(["".join(now["audit"])]),
             pa.array([now["sha"].hexdigest()])], ["grp", *_COUNTS, "cost", "audit", "repaired_sha256"])

    names = ("grp", "sub", "line", "audit", *_COUNTS, "head", "foot", "cost")
    for batch in batches:
        done = []
        for grp, sub, line, audit, *counts, head, foot, cost in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now is None or grp != now["grp"]:
                if now is not None:
                    done.append(row())
                now = {"grp": grp, "sha": hashlib.sha256(), "lines": 0, "audit": [], "foot": None, "cost": cost, **dict.fromkeys(_COUNTS, 0)}
            if sub < 0:
                for c, n in zip(_COUNTS, counts, strict=True):
                    now[c] += n
                if now["foot"] is not None and not LEGAL[now["foot"], head]:
                    now["illegal"] += 1
                now["foot"] = foot
                now["audit"].append(audit)
            else:
                now["sha"].update(("\n" if now["lines"] else "").encode() + line.encode())
                now["lines"] += 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if now is not None:
        yield row()


def repair(rows: DataFrame) -> DataFrame:
    """A row per conv_id of already damaged ``rows`` (conv_id, turn, role, text): see :func:`repair_damaged`."""
    group = F.col("conv_id").cast("string")
    keyed = rows.select(F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("grp"), "conv_id", "turn", "role", "text")
    numbered = _numbered(keyed)
    every = F.array_sort(F.collect_list(F.struct("idx", "who", "fault", "role", "body")))
    chunks = numbered.groupBy("grp", F.floor(F.col("idx") / CHUNK).alias("chunk")).agg(
        F.ceil(F.first("size") / CHUNK).alias("n_chunks"), every.alias("t"))
    chunks = kept(chunks.select("grp", "chunk", "n_chunks", *[F.col(f"t.{c}").alias(c) for c in ("who", "fault", "role", "body")]))
    done = kept(_placed(chunks).mapInArrow(_edits, _DONE))
    items = done.select("grp", F.explode("items").alias("i")).select("grp", "i.*")
    # of the turns with equal role and text one can remain at most
    texts = keyed.groupBy(F.col("grp").alias("g"), F.col("role").alias("r"), F.unhex(F.md5("text")).alias("b")).agg(F.first("text").alias("text"))
    spoken = items.join(texts, (F.col("grp") == F.col("g")) & (F.col("old") == F.col("r")) & (F.col("body") == F.col("b")), "left")
    lines = spoken.select("grp", "idx", "sub", F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))).alias("line"))
    heads = done.select("grp", (F.col("chunk") * CHUNK).alias("idx"), F.lit(-1).alias("sub"), "audit", *_COUNTS, "head", "foot", "cost")
    stream = lines.unionByName(heads, allowMissingColumns=True).repartition("grp").sortWithinPartitions("grp", "idx", "sub")
    repaired = stream.select("grp", "sub", "line", "audit", *_COUNTS, "head", "foot", "cost").mapInArrow(_streamed, _RESULT)
    turn = F.col("turn")
    gaps = keyed.groupBy("grp").agg(F.first("conv_id").alias("conv_id"), F.coalesce(
        F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    return gaps.join(repaired, "grp").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """A row per conv_id of ``rows`` (conv_id, turn, role, text): faults found after the damage, the cheapest edits and what they give.

    Turns go by number, nulls first; those that share one go by role and then by the hash of their text, so repeats are
    neighbours. Nulls of role and text are one space: such a text is blank, such a role has no legal initial. Null
    conv_ids are one conversation. A conversation without rows after the damage has zeros, an empty audit and the
    hash of nothing. An empty table gives no rows; ``turn`` must be an integer; other columns are not looked at.
    """
    shared(rows.sparkSession)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "c")
    ids = rows.select("conv_id").distinct()
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", *_COUNTS, "cost")}
    return (ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
            .withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")),
                          "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}))
