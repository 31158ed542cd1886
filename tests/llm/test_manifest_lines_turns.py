"""The Merkle manifest, conversation repair and line dedup against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from verigauge.llm import conversations, merkle, repeated_lines

DOC = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def up(levels, i):
    """(place, siblings) from level to level"""
    for nodes in levels[:-1]:
        first = i // 8 * 8
        run = nodes[first:first + 8]
        yield i - first, run[:i - first] + run[i - first + 1:]
        i //= 8


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = collections.Counter()
    for k, g in enumerate(order):
        for i, (has, _, x, r) in enumerate(groups[g]):
            steps = [*up(trees[g], i), *up(top, k)]
            forged = has and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            at = leaf(r, r["text"].translate(UPPER)) if forged else x
            for place, others in steps:
                at = sha("".join([*others[:place], at, *others[place:]]))
            out[r["doc_id"], x, trees[g][-1][0], top[-1][0], sha("".join("".join(o) for _, o in steps)), at, at == top[-1][0]] += 1
    return out


def manifest_rows(df):
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                               for r in merkle.manifest(df).collect())


def test_manifest(spark, frame):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Abc", "abc", "", None, "Ünï A", "x" * 50_000]) if i % 7 else f"Text {i}", rng.choice(["en"] * 6 + ["de", "fr", None, "", "é"]),
             rng.choice(["s", None]), rng.choice([None, 5])) for i in range(1500)]
    rows += [(i, "one", lang, "s", 1) for lang, n in (("only", 1), ("eight", 8), ("nine", 9), ("more", 513)) for i in range(n)]
    # rows that share an id, equal rows, null ids
    rows += [(7, "other", "en", "s", 1), *[(9, "Twice", "en", "s", 1)] * 3, (None, "No id", "en", "s", 1), (None, "No id", None, "s", 1), (None, None, None, None, None)]
    rng.shuffle(rows)
    df = frame(rows, DOC)
    assert manifest_rows(df) == brute_manifest([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_small_manifests(spark, frame, n):
    df = frame([(i, f"Text {i}", None if i < 2 else "en", "s", 1) for i in range(n)], DOC)
    assert manifest_rows(df) == brute_manifest([r.asDict() for r in df.collect()])
    assert merkle.manifest(df, with_proof=False).columns[:4] == ["doc_id", "leaf", "subroot", "root"]


def test_many_groups(spark, frame):
    df = frame([(i, "T", f"g{i % 700}", "s", 1) for i in range(1400)], DOC)
    assert manifest_rows(df) == brute_manifest([r.asDict() for r in df.collect()])


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_missing_nodes_are_all_that_is_needed(n):
    """The union over single leaves, less what the leaves give; nothing else is fetched."""
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree(leaves)
    for lo, hi in {(0, n), (0, 1), (n - 1, n), (n // 3, n // 3 + max(1, n // 5)), (n // 2, n)}:
        need = {(level, s) for i in range(lo, hi) for level, _, sib in merkle.path(i, n) for s in sib}
        given = {(level, i // 8 ** level) for i in range(lo, hi) for level in range(len(levels))}
        assert set(merkle.missing(lo, hi, n)) == need - given
        assert len(merkle.missing(lo, hi, n)) == len(need - given)
        nodes = merkle.derive(leaves[lo:hi], lo, n, {c: levels[c[0]][c[1]] for c in merkle.missing(lo, hi, n)})
        assert nodes[merkle.height(n), 0] == levels[-1][0]


def key_of(line):
    return line.strip(BLANKS).translate(UPPER)


def brute_lines(rows):
    """(row) -> Counter of (doc_id, n_lines, n_dropped, kept text); null ids are one document, the smallest"""
    seen = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            seen[key_of(line)].add(doc)
    out = collections.Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key_of(x)) < 40 or len(seen[key_of(x)]) < 5
                or doc == max(seen[key_of(x)], key=lambda d: (d is not None, d or 0))]
        rest = "\n".join(stay)
        out[doc, len(lines), len(lines) - len(stay), sha(rest), rest] += 1
    return out


def line_rows(df):
    return collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.kept_text) for r in repeated_lines.without_repeated_lines(df).collect())


def test_lines(spark, frame):
    rng = random.Random(2)
    pool = [f"line {k} " + "ab " * 14 for k in range(40)]
    pool += ["Ä" * 40, "ä" * 40, "é" * 39, "  \t" + "Word " * 9 + "\r", "word " * 8 + "word", "x" * 39, "", " ", "\x85" + "y" * 40, "z" * 40 + " ", "😀" * 40]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    # one line in most documents, many times in one, repeated rows, repeated ids with other texts, null ids
    rows += [(1000 + i, "common line of forty characters and a few more\nown %d" % i) for i in range(3000)]
    rows += [(500, "\n".join(["common line of forty characters and a few more"] * 300))] * 2 + [rows[3]] * 40 + [(3, "\n".join(pool[:5]))]
    rows += [(None, pool[0] + "\n" + pool[1]), (None, pool[0]), (None, None), (600, ""), (601, None), (602, "\n\n")]
    rng.shuffle(rows)
    df = frame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    assert line_rows(df) == brute_lines(rows)
    # many small batches, so that keys go on over batches, and few documents in ranges
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert line_rows(df.repartition(5)) == brute_lines(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert line_rows(frame([], DOC)) == collections.Counter()


@pytest.mark.parametrize("copies", [4, 5])
def test_lines_at_the_least_number(spark, frame, copies):
    rows = [(i, "a line that has more than forty characters\nshort") for i in range(copies)]
    assert line_rows(frame([(*r, "en", "s", 1) for r in rows], DOC)) == brute_lines(rows)


def test_bitmaps():
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 5000):
        gone = np.unique(rng.integers(0, n, max(1, n // 3)))
        want = np.ones(n, bool)
        want[gone] = False
        assert (repeated_lines.unpack(repeated_lines.pack(gone), n) == want).all()
    assert repeated_lines.unpack(None, 4).all()
    assert len(repeated_lines.pack(np.arange(1_000_000))) < 2000


def brute_repair(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(hit, x)
        convs[c] += [(t, "user" if hit == 4 else r, x)] * {0: 0, 3: 2}.get(hit, 1)
    return {c: repaired(turns) for c, turns in convs.items()}


def repaired(turns):
    if not turns:
        return 0, 0, 0, 0, 0, 0, "", sha("")
    turns = sorted(turns, key=lambda a: (a[0] is not None, a[0] or 0, a[1].encode(), hashlib.md5(a[2].encode()).digest()))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, fault = set(), []
    for _, r, x in turns:
        core = x.strip(BLANKS)
        fault.append("blank" if not core else "duplicate" if (r, x) in seen else "" if core[-1] in ".!?" else "cut")
        seen.add((r, x))
    first = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    to, role = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def better(where, state, value):
        if state not in where or value[:2] < where[state][:2]:
            where[state] = value

    def with_inserts(where):
        for _ in range(4):
            for q, (cost, audit, lines) in list(where.items()):
                better(where, to[q], (cost + 5, audit + "I", (*lines, role[to[q]] + ":")))
        return where

    where = {0: (0, "", ())}
    for (_, r, x), f in zip(turns, fault, strict=True):
        after = {}
        for q, (cost, audit, lines) in with_inserts(where).items():
            better(after, q, (cost + 2, audit + "D", lines))
            if f in ("", "cut"):
                more = 5 if f else 0
                if (q, r[:1]) in keep:
                    better(after, keep[q, r[:1]], (cost + more, audit + "K", (*lines, f"{r}:{x}")))
                better(after, to[q], (cost + more + 1, audit + "R", (*lines, f"{role[to[q]]}:{x}")))
        where = after
    where = with_inserts(where)
    cost, audit, lines = min(where[q] for q in (0, 3) if q in where)
    return gaps, fault.count("blank"), fault.count("duplicate"), fault.count("cut"), illegal, cost, audit, sha("\n".join(lines))


def repair_rows(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in conversations.repair_damaged(df).collect()}


def test_conversations(spark, frame):
    rng = random.Random(1)
    texts = ["a.", "b!", "c", "", "  ", "x?\n", "no end", "é.", "one. two", "z. ", "long " * 20_000 + ".", None]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sys"]
    rows = [(c, None if rng.random() < 0.1 else rng.randint(0, 9), rng.choice(roles), rng.choice(texts)) for c in [*range(80), None] for _ in range(rng.randint(1, 12))]
    # long conversations go over many chunks; one of turns that repeat, one of null turns, some that lose all their rows
    rows += [(1000, t, rng.choice(["user", "assistant"]), f"{t}" + rng.choice([".", "", "!"])) for t in range(1500)]
    rows += [(1001, t % 5, "user", rng.choice(texts[:6])) for t in range(700)]
    rows += [(1002, None, rng.choice(roles[:3]), f"{t}.") for t in range(150)]
    rows += [(1003, t, "system", "s.") for t in range(65)] + [(1004, t, "uxxa"[t % 4], f"{t}") for t in range(129)]
    lost = [c for c in range(2000, 2400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(c, 0, "user", "gone.") for c in lost]
    rng.shuffle(rows)
    df = frame(rows, "conv_id long, turn long, role string, text string")
    got, want = repair_rows(df), brute_repair(rows)
    assert lost and got == want
    assert repair_rows(df.limit(0)) == {}


def test_least_audit_over_all_audits():
    """Every sequence of edits of small conversations, instead of a DP."""
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 5)
        who, fault = [rng.randint(0, 3) for _ in range(n)], [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        best = min(audits(who, fault, 0, 0, n + 3))
        chunks = conversations.Chunks([who], [fault])
        letters, _, last, cost = chunks.least(conversations.ENDS[None, :], np.zeros(1, int))
        audit = "".join("DIKR"[x] for x in letters[0] if x >= 0) + "I" * {0: 0, 1: 2, 2: 1, 3: 0}[int(last[0])]
        assert (int(cost[0]), audit) == best


def audits(who, fault, i, state, left):
    to, after = (2, 2, 3, 2), {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
    if i == len(who) and state in (0, 3):
        yield 0, ""
    if left > 0:
        for cost, audit in audits(who, fault, i, to[state], left - 1):
            yield cost + 5, "I" + audit
    if i < len(who):
        for cost, audit in audits(who, fault, i + 1, state, left):
            yield cost + 2, "D" + audit
        if fault[i] in (0, 3):
            more = 5 if fault[i] else 0
            if (state, who[i]) in after:
                for cost, audit in audits(who, fault, i + 1, after[state, who[i]], left):
                    yield cost + more, "K" + audit
            for cost, audit in audits(who, fault, i + 1, to[state], left):
                yield cost + more + 1, "R" + audit


def test_equal_rows_bring_a_passage_once(spark, frame):
    """Many rows that are equal in id and text: the list of passages does not grow with them."""
    from verigauge.llm.repeats import remove_repeats

    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words), "en", "s", 1)] * 3000 + [(2, " ".join(words[:40]) + " x", "en", "s", 1), (3, "short", "en", "s", 1)]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(frame(rows, DOC), with_text=False).collect())
    assert got == {(1, 300, 300): 3000, (2, 41, 40): 1, (3, 1, 0): 1}
