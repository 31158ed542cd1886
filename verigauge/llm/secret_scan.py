"""Secret scans over a trigram inverted index.

Each rule's pattern is read once and turned into a Boolean query over trigrams that any match must contain: literal runs give
conjunctions, alternatives give disjunctions, and what has no fixed text gives nothing. A task indexes the texts of its
batch: for every trigram that some query names, the sorted list of texts that contain it (lower-cased). Queries
intersect and unite those postings, and only the texts that remain are searched with the pattern. A rule
without a mandatory trigram is searched in every text. Texts are never shuffled and the index of a slice is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verigauge.llm import words as W

#: Most fixed strings that one part of a pattern may stand for before it is cut into conjunctions.
MOST_STRINGS = 128


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    #: Least characters of the group; shorter matches are dropped, but use up their text.
    least: int = 0
    base: bool = False


#: Fixed values. The first three are the base rules of the contract; the others are public token formats.
RULES = (
    Rule("assign", r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A query: True (any text), ("and", parts) or ("or", parts), parts being trigrams (bytes) or queries.
Query = bool | tuple


def _both(a: Query, b: Query) -> Query:
    return b if a is True else a if b is True else ("and", (a, b))


def _any(parts: list[Query]) -> Query:
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What texts with one of the strings contain."""
    parts: list[Query] = []
    for s in sorted(strings):
        raw = s.lower().encode()
        grams = sorted({raw[k:k + 3] for k in range(len(raw) - 2)})
        parts.append(("and", tuple(grams)) if grams else True)
    return _any(parts)


def _read(items) -> tuple[set[str] | None, Query]:
    """(all strings that the items can match, or None; the query)."""
    query: Query = True
    run: set[str] = {""}
    fixed = True
    for op, arg in items:
        strings, inner = _read_one(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        fixed = False
        query = _both(query, _of_strings(run))
        if strings is None:
            query = _both(query, inner)
            run = {""}
        else:
            run = strings
    return (run, True) if fixed else (None, _both(query, _of_strings(run)))


def _read_one(op, arg) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg)}, True
    if op is C.AT:
        return {""}, True
    if op is C.IN and len(arg) <= 8 and all(k is C.LITERAL for k, _ in arg):
        return {chr(v) for _, v in arg}, True
    if op is C.SUBPATTERN:
        return _read(arg[3])
    if op is C.BRANCH:
        parts = [_read(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), True
        return None, _any([_of_strings(s) if s is not None else q for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        lo, hi, inner = arg
        strings, query = _read(inner)
        if strings is not None and hi is not C.MAXREPEAT and hi <= 3 and len(strings) ** hi <= MOST_STRINGS:
            out, powers = set(), {""}
            for k in range(hi + 1):
                out |= powers if k >= lo else set()
                powers = {a + b for a in powers for b in strings}
            return out, True
        return None, True if lo == 0 else query if strings is None else _of_strings(strings)
    return None, True


def trigram_query(pattern: str) -> Query:
    """The trigrams (of lower-cased UTF-8) that every text with a match of ``pattern`` contains."""
    strings, query = _read(_parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _grams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {p for p in query[1] if isinstance(p, bytes)} | set().union(*(_grams(p) for p in query[1] if not isinstance(p, bytes)), set())


class Index:
    """Postings of some trigrams over the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, grams: list[bytes]) -> None:
        low = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint32)
        self.texts = np.arange(len(offsets) - 1)
        self.postings: dict[bytes, np.ndarray] = {}
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        number = {(g[0] << 16) | (g[1] << 8) | g[2]: k for k, g in enumerate(grams)}
        wanted = np.full(1 << 24, -1, np.int16)
        wanted[list(number)] = list(number.values())
        at = np.flatnonzero(wanted[codes] >= 0)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        at, text = at[inside], text[inside]
        pairs = np.unique(wanted[codes[at]].astype(np.int64) * len(offsets) + text)
        gram, text = pairs // len(offsets), pairs % len(offsets)
        cut = np.searchsorted(gram, np.arange(len(grams) + 1))
        for k, g in enumerate(grams):
            self.postings[g] = text[cut[k]:cut[k + 1]]

    def find(self, query: Query | bytes) -> np.ndarray:
        """The texts that a query leaves."""
        if query is True:
            return self.texts
        if isinstance(query, bytes):
            return self.postings[query]
        kind, parts = query
        found = [self.find(p) for p in parts]
        out = min(found, key=len) if kind == "and" else found[0]
        for other in found:
            out = np.intersect1d(out, other, assume_unique=True) if kind == "and" else np.union1d(out, other)
        return out


def _scan_batches(rules: tuple[Rule, ...]):
    compiled = [(k, r, re.compile(r.pattern), trigram_query(r.pattern)) for k, r in enumerate(rules)]
    grams = sorted(set().union(*(_grams(q) for *_, q in compiled)))

    def run(batches):
        for batch in batches:
            column = W.strings(batch.column("text"))
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
            for lo, hi, data, offsets in W.slices(column):
                index = Index(data, offsets, grams)
                texts: dict[int, str] = {}
                raw = data.tobytes()
                for k, rule, pattern, query in compiled:
                    for t in index.find(query).tolist():
                        text = texts.get(t)
                        if text is None:
                            text = texts[t] = raw[offsets[t]:offsets[t + 1]].decode()
                        for m in pattern.finditer(text):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[lo + t].append((m.start(), k, m.end()))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])
    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every document: kind, start and end (code points, end exclusive), by start, then rule.

    Matches of one rule do not overlap; those of different rules may. Null and empty texts have no spans. Repeated rows
    repeat, ids may be null, an empty table gives no rows; other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_scan_batches(rules), f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def digests(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the base rules, and all spans as text."""
    base = [r.kind for r in rules if r.base]

    def line(s):
        return F.concat_ws(":", s["kind"], s["start"], s["end"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    mine = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [count(k) for k in base]
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", F.transform(mine, line)), 256).alias("base_sha256"),
                        F.concat_ws(",", F.transform("spans", line)).alias("spans"))


