"""Vectors, archives, mixes, the language model, the pipeline and the registered queries."""

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from verigauge.llm import language_model, mixing, near_copies, tiles, toxicity, vectors, warc
from verigauge.llm import queries as llm
from verigauge.llm import words as W

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_vectors(rows, threshold=0.93):
    able = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, comp = [0] * len(rows), list(range(len(rows)))
    for i in able:
        for j in able:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    old, new = comp[j], comp[i]
                    comp = [new if c == old else c for c in comp]
    out = collections.Counter()
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if comp[k] == comp[i] and rows[k][0] is not None]
        out[vec_id, links[i], min(ids, default=None)] += 1
    return out


def test_vectors(spark, frame, monkeypatch):
    rng = np.random.default_rng(0)
    rows = []
    for lab in (0, 1, None):
        centre = rng.standard_normal(16)
        for k in range(40):
            v = rng.standard_normal(16) if k % 3 else centre + 0.25 * rng.standard_normal(16)
            rows.append((len(rows), v.tolist(), lab))
    rows += [(200, rows[0][1], 0), (200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (None, rows[0][1], 0), (202, None, 0), (203, [], 0),
             (204, [0.0] * 16, 0), (205, [float("nan")] * 16, 0), (206, [None, *[1.0] * 15], 0), (207, rows[3][1][:8], 0), (208, rows[3][1][:8], 0),
             (209, [-x for x in rows[0][1]], 0), (210, rows[1][1], 1), (None, None, None)]
    # few rows in a bucket, so that crowded ones are cut into blocks
    monkeypatch.setattr(vectors, "BLOCK", 4)
    got = vectors.vector_classes(frame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.vector_classes(frame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_tables_reach_the_recall():
    for n in (10, 10_000, 10 ** 9):
        bits, tables = vectors.tables_for(n)
        p = (1 - math.acos(0.93) / math.pi) ** bits
        assert 1 - (1 - p) ** tables >= vectors.RECALL


PAGES = "page_id long, url string, html string"


def test_warc(spark, frame, tmp_path):
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (4, "http://x/\r\nWARC-Type: fake", "ünï" * 5000), (7, "u", None), (6, "u", ""),
            (None, "u", "alone"), (None, "u", "same"), (11, "u", "two"), (11, "u", "two"), (12, "u", "\r\n\r\nWARC/1.1\r\n")]
    folder, n = warc.write_warc(frame(rows, PAGES))
    assert n == len(rows)
    df = warc.read_warc(spark, folder)
    got = df.where("record_type <> 'warcinfo'").collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = (h or "") in first and i != first[h or ""]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
             first[h or ""] if again else None, None if again else b] += 1
    assert collections.Counter((r.row_id, r.payload_length, r.payload_digest[5:], r.record_type, r.refers_to_row,
                                bytes(r.payload) if r.payload is not None else None) for r in got) == want
    ids = {r.record_id: r for r in got}
    assert all(ids[r.refers_to_id].row_id == r.refers_to_row for r in got if r.record_type == "revisit")
    few = df.where("record_type = 'response' AND row_id IN (4, 5)").select("row_id", "target_uri")
    assert [tuple(r) for r in few.collect()] == [(4, "http://x/%0D%0AWARC-Type: fake")]
    assert "payload" not in warc.read_warc(spark, folder, "row_id long, record_type string").columns
    assert warc.write_warc(frame(rows, PAGES), least_bytes=5)[1] == len(rows)
    assert warc.write_warc(frame([], PAGES))[1] == 0
    # records that another tool wrote: plain text, and gzip without skip lengths
    import gzip
    plain = warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<a>")], b"abc")
    (tmp_path / "a.warc").write_bytes(plain * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(plain.replace(b"abc", b"xyz")))
    rows = warc.read_warc(spark, str(tmp_path)).select("record_type", "payload").collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"abc", b"abc", b"abc", b"xyz"]


def test_warc_skips_payloads(tmp_path, monkeypatch):
    raw = b"".join(warc.member(warc.record([("WARC-Type", t)], os.urandom(200_000))) for t in ("response", "revisit", "response"))
    (tmp_path / "x.warc.gz").write_bytes(raw)
    read = []

    class File:
        def __init__(self):
            self.f = open(tmp_path / "x.warc.gz", "rb")
            self.seek = self.f.seek

        def read(self, n):
            read.append(n)
            return self.f.read(n)
    kinds = [fields["warc-type"] for fields, _ in warc.members(File(), len(raw))]
    assert kinds == ["response", "revisit", "response"]
    assert sum(read) < 20_000


def fill(sizes, weights, total, passes=2.0):
    """Targets by weight, none above ``passes`` times its size, stated plainly."""
    targets, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        unit = rest / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * unit >= passes * sizes[k]]
        for k in full or open_:
            targets[k] = passes * sizes[k] if full else weights[k] * unit
        if not full:
            break
        rest -= sum(targets[k] for k in full)
        open_ = [k for k in open_ if k not in full]
    return targets


def test_targets(spark):
    rng = random.Random(3)
    for _ in range(12):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, rng.randint(1, 1000), rng.randint(1, 10 ** 6)]) for _ in range(n)]
        df = spark.createDataFrame(list(enumerate(sizes)), "k long, words long")
        t = [r.target for r in mixing.with_targets(df, mixing.WEIGHTS, 1.5 * sum(sizes), 2.0).orderBy("k").collect()]
        weights = [mixing.WEIGHTS[k % 3] for k in range(n)]
        assert t == pytest.approx(fill(sizes, weights, 1.5 * sum(sizes)))
        assert sum(t) == pytest.approx(1.5 * sum(sizes))


def taken_words(rows):
    taken, target = collections.Counter(), {}
    for r in rows:
        assert len(r["_shards"]) <= 2
        taken[r.source] += r["_size"] * len(r["_shards"])
        target[r.source] = r["_target"]
    return taken, target


def test_mix_of_long_texts_and_equal_rows(spark, frame, monkeypatch):
    """Long documents and rows that are all alike do not keep a source from its target."""
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 300)
    rows = [(i, "w " * 20, "en", "long", 1) for i in range(3000)] + [(5000 + i, "w " * 20000, "en", "long", 1) for i in range(3)]
    rows += [(9, "w " * 7, "en", "same", 1)] * 4000 + [(i, "w " * 500, "en", "p", 1) for i in range(400)]
    got = mixing.mix(frame(rows, DOC)).collect()
    assert len(got) == len(rows)
    taken, target = taken_words(got)
    assert abs(taken["long"] - target["long"]) <= 10
    assert abs(taken["same"] - target["same"]) <= 3.5 and abs(taken["p"] - target["p"]) <= 250


def test_mix_of_many_sources(spark, frame):
    """Sources are planned in tasks; blocks of small ones spread over all shards."""
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 700:04}", 1) for i in range(2800)]
    df = frame(rows, DOC)
    got = mixing.mix(df, shards=10).collect()
    size, (taken, target) = collections.Counter(), taken_words(got)
    for r in got:
        size[r.source] += r["_size"]
    names = sorted(size)
    want = fill([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()))
    assert [target[s] for s in names] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 3.5 for s in names)
    assert {s for r in got for s in r["_shards"]} == set(range(10))


def test_split():
    quotas = np.array([500, 0, 7, 90])
    out = mixing.split(quotas, 13, np.random.default_rng(1))
    assert (out.sum(0) == quotas).all() and out.min() >= 0
    assert set((out.sum(1) - quotas.sum() // 13).tolist()) <= {0, 1, -1}


def test_mix(spark, frame):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), "en", rng.choice(["b", "a", "é", None, "b", "b"]), 1) for i in range(1500)]
    rows += [(None, None, None, None, None), (7, "", "en", "empty", 0), (1, rows[1][1], "en", rows[1][3], 1)]
    df = frame(rows, DOC)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r["_size"] == len(WORD.findall(r.text or ""))
        assert r["_size"] * len(r["_shards"]) <= 2 * r["_size"]
        size[r.source] += r["_size"]
        taken[r.source] += r["_size"] * len(r["_shards"])
        target[r.source] = r["_target"]
    names = sorted(s for s in size if s is not None) + [None]
    want = fill([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()))
    assert [target[s] for s in names] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 16 for s in names)
    assert all(r["_source_size"] == size[r.source] for r in got)
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda rs: sorted((str(r.doc_id), tuple(r["_shards"])) for r in rs)
    assert key(got) == key(again)
    drawn = mixing.shuffled(mixing.mix(df), df.columns)
    assert drawn.columns == df.columns and drawn.count() == sum(len(r["_shards"]) for r in got)
    assert mixing.mix(frame([], DOC)).count() == 0


def test_mix_with_clashing_columns(spark, frame):
    plain = frame([(i, "w " * (i % 9), "en", "ab"[i % 2], 1) for i in range(300)], DOC)
    taken = ["_size", "_spot", "_SHARDS", "_source_size", "_target", "_block", "_k"]
    df = plain.selectExpr("*", *[f"'mine' AS {c}" for c in taken])
    names = mixing.added(df)
    assert not {n.lower() for n in names} & {c.lower() for c in df.columns}
    key = lambda rows, cols: sorted(tuple(map(str, (r.doc_id, *(r[c] for c in cols)))) for r in rows)
    assert key(mixing.mix(df).collect(), names) == key(mixing.mix(plain).collect(), mixing.added(plain))
    out = corpus_pipeline.to_weights(spark, df, SF)
    rows = out.collect()
    assert out.columns == df.columns and all(r[c] == "mine" for r in rows for c in taken)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in corpus_pipeline.to_weights(spark, plain, SF).collect())


def brute_model(texts, held):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[*WORD.findall((t or "").translate(low)), None] for t in texts]
    c, b = collections.Counter(), collections.Counter()
    for t, h in zip(toks, held):
        if not h:
            c.update(t)
            b.update(zip([False, *t], t))
    n, v = sum(c.values()), len(c)
    after, before = collections.Counter(x for x, _ in b), collections.Counter(w for _, w in b)
    del after
    few, less = collections.Counter(b.values()), collections.Counter(before.values())
    d2, d1 = (language_model.discounts([k[i] for i in (1, 2, 3, 4)]) for k in (few, less))

    def cut(d, k):
        return d[min(k, 3) - 1] if k else 0
    floor = (sum(cut(d1, k) * m for k, m in less.items()) / len(b) if b else 1) / (v + 1)
    total, gap = collections.Counter(), collections.Counter()
    for (x, _), k in b.items():
        total[x] += k
        gap[x] += cut(d2, k)

    def single(w):
        return floor + ((before[w] - cut(d1, before[w])) / len(b) if before[w] else 0)

    def p(x, w):
        return single(w) if not total[x] else (b[x, w] - cut(d2, b[x, w])) / total[x] + gap[x] / total[x] * single(w)
    if c:
        for x in [False, *list(c)[:20]]:
            assert sum(p(x, w) for w in c) + (gap[x] / total[x] if total[x] else 1) * floor == pytest.approx(1)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
             sum(math.log10(p(x, w)) for x, w in zip([False, *t], t))) for t in toks]


@pytest.mark.parametrize("chars", [1 << 25, 500])
def test_language_model(spark, frame, monkeypatch, chars):
    monkeypatch.setattr(language_model, "BUCKET_CHARS", chars)
    rng = random.Random(chars)
    vocab = ["The", "the", "a", "Ünï", "xé", *["w%d" % k for k in range(60)]]
    texts = [" ".join(vocab[int(rng.random() ** 3 * len(vocab))] for _ in range(rng.randint(0, 60))) for _ in range(120)]
    texts += [None, "", "unseen words only", "a " * 4000, *texts[:3]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "the a", "en", "s", 0)]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    want = brute_model([r[1] for r in rows], held)
    got = {r.doc_id: r for r in language_model.score_texts(frame(rows, DOC)).collect()}
    for (i, *_), h, w in zip(rows, held, want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, *w[:3])
        assert (r.base_score, r.score) == (pytest.approx(w[3]), pytest.approx(w[4]))
    assert language_model.score_texts(frame([], DOC)).count() == 0
    lone = language_model.score_texts(frame([(None, "a b", "en", "s", 0)], DOC)).first()
    assert lone.held_out and lone.n_known == 0 and lone.train_tokens == 0 and lone.score == pytest.approx(0)


def brute_grams(texts, held, order):
    """Scores by the recursive definition over plain counters."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[False, *WORD.findall((t or "").translate(low)), None] for t in texts]
    learn = [t for t, h in zip(toks, held) if not h]
    seen = {k: collections.Counter(tuple(t[i:i + k]) for t in learn for i in range(len(t) - k + 1)) for k in range(1, order + 1)}
    c = {order: seen[order]}
    for k in range(1, order):
        before = collections.Counter(g[1:] for g in seen[k + 1])
        c[k] = {g: n if g[0] is False else before[g] for g, n in seen[k].items() if k > 1 or g[0] is not False}
    d = {}
    after = collections.defaultdict(list)
    for k in c:
        few = collections.Counter(c[k].values())
        d[k] = language_model.discounts([few[i] for i in (1, 2, 3, 4)])
        for g, n in c[k].items():
            after[g[:-1]].append(n)

    def cut(k, n):
        return d[k][min(n, 3) - 1] if n else 0

    def p(g):
        k, h = len(g), after.get(g[:-1], [])
        lower = p(g[1:]) if k > 1 else 1 / (len(c[1]) + 1)
        n = c[k].get(g, 0)
        return (n - cut(k, n) + sum(cut(k, x) for x in h) * lower) / sum(h) if h else lower
    return [sum(math.log10(p(tuple(t[max(0, i - order + 1):i + 1]))) for i in range(1, len(t))) for t in toks]


@pytest.mark.parametrize("order,chars", [(2, 500), (3, 1 << 25), (3, 500), (4, 500)])
def test_language_model_order(spark, frame, monkeypatch, order, chars):
    monkeypatch.setattr(language_model, "BUCKET_CHARS", chars)
    rng = random.Random(order)
    vocab = ["The", "the", "a", "Ünï", *["w%d" % k for k in range(20)]]
    texts = [" ".join(vocab[int(rng.random() ** 3 * len(vocab))] for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "unseen words only", "the a w1 unseen the a w1", "a " * 4000, *texts[:3]]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    want = brute_grams(texts, held, order)
    got = {r.doc_id: r.score for r in language_model.score_texts(frame(rows, DOC), order=order).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(want)
    lone = language_model.score_texts(frame([(None, "a b", "en", "s", 0)], DOC), order=order).first()
    assert lone.score == pytest.approx(0)


def test_language_model_query_has_trigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.score for r in language_model.score_texts(docs, order=3).collect()}
    assert {r.doc_id: pytest.approx(r.score) for r in llm.QUERIES["op6_language_model"](spark, SF).collect()} == want


@pytest.mark.parametrize("bits,n", [(0, 5000), (12, 50_000), (16, 3000)])
def test_keys_of_a_bucket(tmp_path, bits, n):
    rng = np.random.default_rng(bits)
    top = np.uint64(1 << (64 - bits)) if bits else np.uint64(0)
    keys = np.unique(rng.integers(0, 1 << (64 - max(1, bits)), n, dtype=np.uint64) + top)
    some = np.sort(np.concatenate([keys[::3], keys[::7] + np.uint64(1)]))
    path = str(tmp_path / f"keys-{bits}")
    language_model._put_keys(path, keys, bits)
    assert (language_model._fine(bits, len(keys)) > 0) == (bits > 0)
    want = {int(k): i for i, k in enumerate(keys)}
    assert language_model._places(path, len(keys), bits, some).tolist() == [want.get(int(k), -1) for k in some]


def test_unmix():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (language_model._unmix(W.mix(x)) == x).all()


def test_entry():
    names = set(entry.queries())
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if re.match(r"op\d+_", n)}
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_query_covers_its_table(spark, name):
    table = {"op1": "embeddings", "op5": "pages", "op12": "conversations"}.get(name.split("_")[0], "documents")
    rows = entry.queries()[name](spark, SF).collect()
    key = {"embeddings": "vec_id", "pages": "page_id", "documents": "doc_id", "conversations": "conv_id"}[table]
    want = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    want = sorted(set(want)) if table == "conversations" else want
    assert sorted(r[key] for r in rows) == sorted(want)


def test_pipeline(spark):
    """Each stage does to its own input what its operator says, row by row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    at = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        kept.append(at.collect())
        assert at.columns == names or name == "token_ids"
    one = [sorted(r.doc_id for r in rows) for rows in kept]
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert one[0] == sorted(r.doc_id for r in docs.collect() if r.doc_id not in toxic)
    frames = [spark.createDataFrame(k, docs.schema) for k in kept[:4]]
    classes = near_copies.near_copy_classes(frames[0]).where("kept").collect()
    assert one[1] == sorted(r.doc_id for r in classes)
    clean = tiles.contamination(frames[1], bench).where("size(matches) = 0").collect()
    assert one[2] == sorted(r.doc_id for r in clean)
    mixed = mixing.mix(frames[2]).collect()
    assert one[3] == sorted(r.doc_id for r in mixed for _ in r["_shards"])
    assert one[4] == one[3]
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == sorted(tuple(r) for r in kept[4])
