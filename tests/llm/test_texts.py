"""Operators on documents against brute force, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from verigauge.llm import near_copies, repeats, secret_scan, tiles, token_files, toxicity
from verigauge.llm import words as W
from verigauge.llm.graphs import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(texts, source="s"):
    return [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


EDGES = [None, "", " \t\n", "one", "é ü", "one", None, "a" * 50_000, "x " * 3000, "tab\tand\x0bmore\r\nlines"]


def test_words():
    texts = ["a b", "", "cd", "ef  gh\x1cx ", "ij"]
    (lo, hi, data, offsets), = W.slices(W.strings(pa.array(texts)))
    starts, ends, first = W.spans(data, offsets)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert got == [w for t in texts for w in WORD.findall(t)]
    assert first.tolist() == [0, 2, 2, 3, 5, 6]
    h = W.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(got))
    again = W.hashes(np.frombuffer(b"zz cd", np.uint8), np.array([3]), np.array([5]))
    assert again[0] == h[2]
    assert sum(1 for _ in W.slices(W.strings(pa.array(texts)), 2)) == 4


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    rows = [*edges, (None, 3), (7, None)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 8])
def test_repeats(spark, frame, window):
    rng = random.Random(window)
    passage = prose(rng, 90)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(25)]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(6)]
    cut = passage.split()
    texts += [" ".join(cut[:50]) + " " + prose(rng, 30), "b " * 100 + passage, " ".join(cut[20:20 + window]), "a b " * 60, "q " * (window + 1)]
    texts += [texts[3], texts[3], *EDGES]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           repeats.remove_repeats(frame(docs(texts), DOC), window=window).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, window)


def test_repeats_of_rows(spark):
    t = " ".join(str(k) for k in range(40))
    rows = spark.createDataFrame([(1, t), (1, t), (None, "short"), (None, t + " x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in repeats.remove_repeats(rows).collect())
    assert got == [("1", 40, ""), ("1", 40, ""), ("None", 0, "short"), ("None", 40, "x")]
    assert repeats.remove_repeats(rows.limit(0)).count() == 0


def test_anchor_depends_on_window_only():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 4, 35).astype(np.uint64)
    seen = set()
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(0, 60)), rng.integers(0, 4, rng.integers(0, 60))
        w = W.mix(np.concatenate([a.astype(np.uint64), core, b.astype(np.uint64)]))
        p, name, place = repeats.anchors(w, np.array([0, len(w)]))
        k = np.flatnonzero(p == len(a))[0]
        seen.add((int(name[k]), int(place[k] - p[k])))
    assert len(seen) == 1


def labelled(text):
    (_, _, data, offsets), = W.slices(W.strings(pa.array([text]), lower=True))
    return near_copies._labelled(data, offsets)[1]


def brute_similarity(a, b):
    """Longest common subsequence of labelled shingles by dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1]) if row[-1] else 0.0


def test_alignment():
    rng = random.Random(5)
    for _ in range(40):
        w = prose(rng, 60, "abc").split()
        v = list(w)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(v))
            v[k:k + rng.randint(0, 2)] = prose(rng, rng.randint(0, 2), "abc").split()
        a, b = labelled(" ".join(w)).tolist(), labelled(" ".join(v)).tolist()
        want = brute_similarity(a, b)
        got = near_copies.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.5)
        assert got == pytest.approx(want) if want >= 0.5 else got < 0.5


def test_near_copies(spark, frame):
    rng = random.Random(2)
    base = prose(rng, 150)
    texts = [prose(rng, 120) for _ in range(20)]

    def edited(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        return " ".join(w)
    crowd = [edited(base, rng.randint(1, 6)) for _ in range(60)]
    swapped = " ".join(base.split()[75:] + base.split()[:75])
    texts += [base, *crowd, base.upper(), base, swapped, *EDGES]
    lab = [labelled(t or "").tolist() for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if lab[i] and lab[j] and want[i] != want[j] and brute_similarity(lab[i], lab[j]) >= 0.8:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    rows = near_copies.near_copy_classes(frame(docs(texts), DOC)).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(want))
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    left = near_copies.without_near_copies(frame(docs(texts) + [docs(texts)[0]], DOC))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want))


def test_near_copies_edges(spark):
    rows = spark.createDataFrame([(None, "one two three four five six"), (4, "one two three four five six"), (4, None), (None, None), (4, "!")],
                                 "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in near_copies.near_copy_classes(rows).collect())
    assert got == [("4", "4", 1, True), ("4", "4", 1, True), ("4", "4", 2, True), ("None", "4", 2, False), ("None", "None", 1, True)]
    assert near_copies.near_copy_classes(rows.limit(0)).count() == 0
    assert near_copies.without_near_copies(rows.limit(0)).count() == 0
    assert near_copies.without_near_copies(rows).count() == 4


def brute_tiles(item, doc, least):
    """Greedy string tiling, straight from its definition."""
    mi, md, tiles_ = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in mi and j + n not in md):
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        i, j, n = best
        if n < least:
            return tiles_
        mi |= set(range(i, i + n))
        md |= set(range(j, j + n))
        tiles_.append(best)


def test_tiles(spark, frame):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (40, 25, 12, 5, 3)] + [None, "", "a b " * 12]
    p = items[0].split()
    texts = [prose(rng, 80) for _ in range(6)]
    texts += [prose(rng, 20) + " " + items[0].upper().replace(" ", ", ") + " " + prose(rng, 9),
              " ".join(p[20:]) + " zz " + " ".join(p[:20]), " ".join(p[:16]), items[1] + " " + items[2], items[4], "a b " * 30, *EDGES]
    norm = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    want = {}
    for d, doc in enumerate(norm):
        for i, item in enumerate(items):
            w = re.findall(r"[a-z0-9]+", (item or "").lower())
            if len(w) >= 5:
                found = brute_tiles(w, doc[:300], 5)
                share = sum(t[2] for t in found) / len(w)
                if share >= 0.5:
                    want[d, i] = round(share, 9)
    bench = frame(list(enumerate(items)), "item_id long, text string")
    rows = tiles.contamination(frame(docs(texts), DOC), bench).collect()
    got = {(r.doc_id, m.item_id): round(m.coverage, 9) for r in rows for m in r.matches}
    assert got == want and len(rows) == len(texts)
    assert (7, 0) in got and (8, 0) not in got
    clean = tiles.without_contaminated(frame(docs(texts), DOC), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [d for d in range(len(texts)) if not any(k[0] == d for k in want)]
    assert tiles.contamination(frame(docs(texts), DOC), bench.limit(0)).where("size(matches) > 0").count() == 0
    assert tiles.contamination(frame([], DOC), bench).count() == 0


def test_tile_order():
    rng = random.Random(9)
    for _ in range(60):
        item = [rng.choice("abc") for _ in range(14)]
        doc = [rng.choice("abc") for _ in range(20)]
        pairs = [(i, j) for i in range(12) for j in range(18) if item[i:i + 3] == doc[j:j + 3]]
        one = np.ones(len(pairs), int)
        i, j = np.array(pairs, int).reshape(-1, 2).T
        got = tiles.tile(len(item), len(doc), tiles.common_runs(i, one, j, one, 3) if pairs else [], 3)
        assert sorted(got) == sorted(brute_tiles(item, doc, 3))


def test_tiles_of_repeated_words(spark, frame, monkeypatch):
    """Runs of one word, items without ids and with equal ones, over many blocks."""
    monkeypatch.setattr(tiles, "BLOCK_CHARS", 20)
    items = [(None, "go " * 12), (None, "no " * 12), (3, "go " * 7 + "x y z " + "go " * 6), (3, "go go go go"), (4, "a b c d e f g")]
    texts = ["go " * 9, "go " * 30, "x y z " + "go " * 9 + "x y z " + "go " * 3, "no " * 11 + "go " * 5, "a b c d e f g " * 3, "ab " * 6]
    want = collections.Counter()
    for d, doc in enumerate(texts):
        for i, item in items:
            if len(item.split()) >= 5:
                found = brute_tiles(item.split(), doc.split(), 5)
                if sum(t[2] for t in found) >= 0.5 * len(item.split()):
                    want[d, -1 if i is None else i, tuple(sorted(found))] += 1
    rows = tiles.contamination(frame(docs(texts), DOC), frame(items, "item_id long, text string")).collect()
    got = collections.Counter((r.doc_id, m.item_id, tuple(tuple(t) for t in m.tiles)) for r in rows for m in r.matches)
    assert got == want and len({k[:2] for k in want}) >= 5


def test_long_run_of_one_word_is_no_square():
    p, q = np.array([496]), np.array([19996])
    runs = tiles.common_runs(np.array([0]), p, np.array([0]), q, 5)
    assert len(runs) == 496 + 19996 - 1 and max(r[0] for r in runs) == 500
    assert tiles.tile(500, 20000, runs, 5) == [(0, 0, 500)]


def brute_secrets(text):
    out = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[rule.group]) >= rule.least]
    return [(secret_scan.RULES[k].kind, a, b) for a, k, b in sorted(out)]


def test_secrets(spark, frame):
    rng = random.Random(6)
    parts = ["PassWord = 'hunter2hunter2'", "token: x", "api_key=abcdefgh1", "APIKEY:\"zzzzzzzz\"", "AKIA" + "Q" * 12, "AKIA1", "0123456789abcdef" * 2,
             "deadbeef", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, "ünï", "secret: token: abcdefgh12", "xoxb-123456-abcdef", "sk_live_" + "9" * 20,
             "passwd==aaaaaaaa", "ſecret=abcdefgh", "toKen=abcdefgh"]
    texts = [" ".join(rng.choice([prose(rng, 3), rng.choice(parts)]) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts += ["".join(parts), "tok", "en=abcdefgh", *EDGES]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.find_secrets(frame(docs(texts), DOC)).collect()}
    assert got == {i: brute_secrets(t or "") for i, t in enumerate(texts)}
    row = secret_scan.digests(secret_scan.find_secrets(frame(docs(["AKIA" + "Q" * 12]), DOC))).first()
    assert (row.n_assign, row.n_access, row.n_hex, row.spans) == (0, 1, 0, "access:0:16")
    assert row.base_sha256 == hashlib.sha256(b"access:0:16").hexdigest()
    assert secret_scan.find_secrets(frame([], DOC)).count() == 0


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{32,}") is True
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    kind, parts = secret_scan.trigram_query("(foo|barn)x*")
    assert kind == "or" and set(parts) == {("and", (b"arn", b"bar")), ("and", (b"foo",))}
    assert secret_scan.trigram_query("a(foo)?b[cd]") is not None
    for rule in secret_scan.RULES:
        if rule.kind != "hex":
            assert secret_scan.trigram_query(rule.pattern) is not True


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 32])
def test_packing(tmp_path, bits):
    rng = np.random.default_rng(bits)
    lists = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 500, 70_000, 0, 3)]
    path = tmp_path / "ids.bin"
    path.write_bytes(b"".join(token_files.file_chunks(iter(lists), bits, 1000)))
    f = token_files.IdFile(str(path))
    for k, want in enumerate(lists):
        assert np.array_equal(f.document(k), want)
    flat = np.concatenate(lists)
    assert np.array_equal(f.ids(990, 2010), flat[990:2010])
    empty = tmp_path / "none.bin"
    empty.write_bytes(b"".join(token_files.file_chunks(iter([]), bits)))
    assert len(token_files.IdFile(str(empty)).ids(0, 0)) == 0


def test_token_files(spark, frame):
    from tokenizers import Tokenizer

    from verigauge.llm.queries import public_tokenizer
    rng = random.Random(8)
    texts = [prose(rng, 50) for _ in range(10)] + ["It's 42% of Á \x1c x y <|endoftext|> a<|startoftext|>b", "don't STOP\nNow!", *EDGES]
    plain = Tokenizer.from_file(public_tokenizer())
    rows = docs(texts)
    rng.shuffle(rows)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_ids(token_files.write_ids(frame(rows, DOC), public_tokenizer())).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    assert token_files.read_ids(token_files.write_ids(frame([], DOC), public_tokenizer())).count() == 0
    twice = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.start, r.n_tokens) for r in token_files.read_ids(token_files.write_ids(twice, public_tokenizer())).collect())
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == ["None", "3", "3", "3"] and sum(g[2] for g in got) == 7


def test_toxicity(spark, frame):
    rng = random.Random(12)
    bad = ["grumpkin", "snorvel", "blixter"]
    texts, labels = [], []
    for i in range(700):
        w = prose(rng, rng.randint(5, 120), "abcdehinorst").split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(1, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    texts += [prose(rng, 30, "abcdehinorst") + " gruumpkin snorvell", *EDGES]
    frame_docs = frame(docs(texts), DOC)
    table = frame([*labels, (None, 1), (2, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(frame_docs, table).collect()}
    assert len(rows) == len(texts)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in set(held)) for i, _ in labels)
    right = sum(rows[i].predicted == labels[i][1] for i in held)
    assert right >= 0.95 * len(held)
    assert rows[700].predicted == 1
    assert all(rows[701 + k].predicted == 0 for k, t in enumerate(EDGES) if not (t or "").strip())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    again = {r.doc_id: r.score for r in toxicity.toxicity(frame_docs, table).collect()}
    assert again == {i: r.score for i, r in rows.items()}
    left = toxicity.without_toxic(frame_docs, table)
    assert left.columns == frame_docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in rows.items() if not r.predicted}
    assert toxicity.toxicity(frame([], DOC), table).count() == 0
    none = toxicity.toxicity(frame_docs, table.limit(0)).select("score").distinct().count()
    assert none == 1


def test_toxicity_counts_texts():
    """Evidence of a few toxic texts counts; a subword of one text has no weight, whatever pieces that text lends."""
    one = lambda *b: (np.array(b, np.int32), np.ones(len(b), np.float32))
    rows = [(0, *one(1, 2, 3, k + 100), True) for k in range(60)] + [(1, *one(1, 2, 3, 7), True)] * 2
    rows += [(1, *one(1, 2, 9, 200 + k % 20), True) for k in range(40)] + [(0, *one(1, 2, 3, 8), True)] + [(0, *one(2, 8), False)] * 24
    weights, _ = toxicity.fit(rows)
    assert weights[7] > 0 and weights[9] > 0 and weights[8] == 0 and weights[100] == 0
