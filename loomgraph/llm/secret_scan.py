"""Secret scans over a trigram inverted index.

From the parse tree of each rule's regular expression a Boolean trigram query is derived: every match must contain the
trigrams that the query asks for (AND along a concatenation, OR across alternatives). Every Arrow batch of documents is an
index segment: trigram -> sorted list of the segment's documents, kept for the trigrams that some rule asks for. A rule's
candidates are the intersections and unions of these postings, and only candidates are verified with the regular
expression; a rule without a mandatory trigram (plain hexadecimal runs) scans every document.

Segments live where the text lives, as in document-partitioned search engines: no shuffle, memory bounded by a batch, and
a lost executor only repeats its own segments. The index is folded to lower case (A-Z), so it may propose too many
documents but never misses one.

Rules take time in proportion to a text, hostile ones included: each looks for its end from a start at most once per run of
characters (tests hold every rule to texts of a megabyte).

Spans are in code points, end exclusive, leftmost and non-overlapping per kind. Defined cases: a null or empty text has no
spans (digest of the empty string); very long texts are scanned whole; repeated rows and rows without a key give one row each;
an empty table gives an empty result; extra columns pass through `redact_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


@dataclass(frozen=True)
class SecretRule:
    """A kind with its pattern; a match counts if group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's base rules, fixed values. [0-9a-f]{24,} finds what [0-9a-f]+ finds at 24 characters or more.
BASE_RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the method adds.
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    SecretRule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++"),
    SecretRule("google_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    SecretRule("url_login", r"://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
)

#: A query is True (no trigram is mandatory), a trigram (bytes), or ("and" | "or", frozenset of queries).
Query = bool | bytes | tuple
_MOST_STRINGS = 64


def _join(op: str, parts: list[Query]) -> Query:
    flat: set[Query] = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == op else {p}
    if not flat:
        return True
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of_strings(strings: frozenset[bytes]) -> Query:
    """What any of these strings, as a whole part of every match, demands."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _strings(item: tuple) -> frozenset[bytes] | None:
    """All folded strings that an atom can match, or None if there are too many."""
    op, arg = item
    if op is C.LITERAL:
        return frozenset([chr(arg).encode().lower()])
    if op is C.IN and all(o is C.LITERAL for o, _ in arg):
        return frozenset(chr(a).encode().lower() for _, a in arg)
    if op is C.AT:
        return frozenset([b""])
    if op in (C.SUBPATTERN, C.MAX_REPEAT, C.MIN_REPEAT, C.BRANCH):
        return _walk([item])[0]
    return None


def _walk(items) -> tuple[frozenset[bytes] | None, Query]:
    """(all strings of a sequence if few, its query)."""
    known, asked, whole = frozenset([b""]), [], True
    for op, arg in items:
        query: Query = True
        if op is C.SUBPATTERN:
            strings, query = _walk(arg[-1])
        elif op is C.BRANCH:
            parts = [_walk(b) for b in arg[1]]
            strings = frozenset().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            query = _join("or", [q for _, q in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            strings, query = _walk(inner)
            if strings is not None and int(high) <= 2 and low <= 1 and int(high) == 1:
                strings = strings | frozenset([b""] if low == 0 else [])
            elif strings is None or low != high or len(strings) != 1:
                strings = None
            else:
                strings = frozenset(s * low for s in strings)
            query = query if low else True
        else:
            strings = _strings((op, arg))
        joined = None if strings is None else frozenset(a + b for a in known for b in strings)
        if joined is None or len(joined) > _MOST_STRINGS:
            asked += [_of_strings(known), query]
            known, whole = frozenset([b""]) if joined is None else strings, False
        else:
            known = joined
    asked.append(_of_strings(known))
    return (known if whole else None), _join("and", asked)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of pattern satisfies (on text folded to lower case)."""
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1])) if isinstance(query, tuple) else set()


class Segment:
    """Inverted index of one batch: postings (sorted document numbers) of the given trigrams."""

    _FOLD = np.arange(256, dtype=np.uint8)
    _FOLD[65:91] += 32

    def __init__(self, texts: list[bytes], vocabulary: list[bytes], slots: np.ndarray):
        self.n = len(texts)
        flat = self._FOLD[np.frombuffer(b"\0\0".join(texts), np.uint8)].astype(np.int32)
        codes = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:] if len(flat) > 2 else np.zeros(0, np.int32)
        slot = slots[codes]
        at = np.flatnonzero(slot)
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = np.unique(slot[at].astype(np.int64) * (self.n + 1) + np.searchsorted(ends, at, "right"))
        slot, doc = pairs // (self.n + 1), pairs % (self.n + 1)
        borders = np.searchsorted(slot, np.arange(1, len(vocabulary) + 2))
        self.postings = {g: doc[borders[i] : borders[i + 1]] for i, g in enumerate(vocabulary)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        out = None
        for part in sorted((self.candidates(q) for q in query[1]), key=len):
            out = part if out is None else (np.intersect1d if query[0] == "and" else np.union1d)(out, part)
        return out


def _slots(vocabulary: list[bytes]) -> np.ndarray:
    slots = np.zeros(1 << 24, np.uint8 if len(vocabulary) < 255 else np.uint16)
    for i, g in enumerate(vocabulary):
        slots[int.from_bytes(g, "big")] = i + 1
    return slots


def scan_texts(texts: list[bytes], rules: tuple[SecretRule, ...], compiled, vocabulary, slots) -> list[list[tuple[int, int, int]]]:
    """Per text the spans (start, rule number, end) in order."""
    segment = Segment(texts, vocabulary, slots) if vocabulary else None
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    decoded: dict[int, str] = {}
    for r, (rule, (regex, query)) in enumerate(zip(rules, compiled, strict=True)):
        for d in (segment.candidates(query) if segment else range(len(texts))):
            text = decoded.get(d)
            if text is None:
                text = decoded[d] = texts[d].decode("utf-8", "replace")
            for m in regex.finditer(text):
                if len(m[rule.group]) >= rule.least:
                    found[d].append((m.start(), r, m.end()))
    for spans in found:
        spans.sort()
    return found


def _said(spans, rules, base: int | None = None) -> str:
    return ",".join(f"{rules[r].kind}:{a}:{b}" for a, r, b in spans if base is None or r < base)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _prepared(rules: tuple[SecretRule, ...]):
    compiled = [(re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
    vocabulary = sorted(set().union(*(trigrams_of(q) for _, q in compiled)))
    return compiled, vocabulary, _slots(vocabulary)


def scan_documents(df: DataFrame, key: str = "doc_id", text: str = "text", base: tuple[SecretRule, ...] = BASE_RULES, more: tuple[SecretRule, ...] = MORE_RULES) -> DataFrame:
    """key, n_<kind> per base kind, base_sha256, spans: one row per row of df; only key and text are read."""
    bounded_batches(df.sparkSession)
    rules = (*base, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _prepared(rules)
        for batch in batches:
            found = scan_texts([t or b"" for t in batch.column(1).to_pylist()], rules, *prepared)
            counts = [pa.array([sum(x[1] == r for x in spans) for spans in found], pa.int64()) for r in range(len(base))]
            digest = pa.array([hashlib.sha256(_said(s, rules, len(base)).encode()).hexdigest() for s in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([_said(s, rules) for s in found], pa.string())], names=names)

    names = [key, *(f"n_{r.kind}" for r in base), "base_sha256", "spans"]
    schema = f"`{key}` {dict(df.dtypes)[key]}, " + ", ".join(f"n_{r.kind} long" for r in base) + ", base_sha256 string, spans string"
    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def redact_documents(df: DataFrame, text: str = "text", rules: tuple[SecretRule, ...] = BASE_RULES + MORE_RULES, mark: str = "[REDACTED]") -> DataFrame:
    """df with every span replaced by mark (overlapping spans by one); n_chars follows, all else stays."""
    bounded_batches(df.sparkSession, 4)
    at = df.columns.index(text)
    numbered = df.toDF(*(f"_c{i}" for i in range(len(df.columns)))).withColumn(f"_c{at}", F.col(f"_c{at}").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = _prepared(rules)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = scan_texts([t or b"" for t in texts], rules, *prepared)
            new = [_redacted(t.decode("utf-8", "replace"), s, mark).encode() if s else t for t, s in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    done = numbered.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in numbered.dtypes))
    clean = F.col(f"_c{at}").cast("string")
    value = lambda i, c: clean if i == at else F.coalesce(F.char_length(clean), F.lit(0)).cast(df.schema[i].dataType) if c == "n_chars" else F.col(f"_c{i}")
    return done.select(*(value(i, c).alias(c) for i, c in enumerate(df.columns)))
