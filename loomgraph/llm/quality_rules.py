"""Quality rules: line-first cleaning.

Each \n-split line is judged on its own by three rules: punctuation (symbol runs glued to words, shouting), navigation
(lists cut up by separators, link words) and boilerplate (repeats of an earlier line, one word over and over, notices about
cookies and scripts). Failing lines are removed; a document that loses too large a share of its words is rejected, and so
is one that fails the base rules (too few words, too many words in repeated 5-word windows).

Words are runs of characters other than \x20 and \x09-\x0D. Defined cases: a null or empty text has no words, so all
counts are 0 and base_failed is true; lines without a word are kept as they are and count for nothing; repeated rows give
one row each; extra columns pass through `clean_documents` untouched, whatever their names; rows with a null key are judged
as any other; very long texts are judged whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document's rejection."""

    symbol_share: float = 0.3  # of a line's words that carry symbols or end in doubled marks
    least_words: int = 4  # lines with fewer are not judged by shares
    separator_share: float = 0.2  # of a line's words that are bare separators
    top_word_share: float = 0.5  # of a line's words that are one word, in lines of 10 or more
    lost_share: float = 0.5  # of the document's words in removed lines, above which it is rejected


#: Base rules of the contract, fixed values.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
_GLUED = re.compile(rb"[#*$%&<>]{2,}|[!?]{2}")
_SEPARATORS = {b"|", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"/", b"\xc2\xb7", b"\xe2\x80\xa2", b"::"}
_NOTICES = (b"cookie policy", b"we use cookies", b"enable javascript", b"javascript is disabled", b"terms of use", b"privacy policy", b"all rights reserved", b"lorem ipsum")
_LINKS = {b"home", b"login", b"register", b"menu", b"next", b"previous", b"share", b"subscribe", b"search", b"sitemap", b"contact", b"about", b"tweet", b"back", b"top"}


def line_fails(line: bytes, words: list[bytes], rules: LineRules) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    if any(x in (low := line.lower()) for x in _NOTICES) and n <= 30:
        return "boilerplate"
    if n >= 3 and all(w.strip(b".,:|") in _LINKS for w in low.split()):
        return "navigation"
    if n < rules.least_words:
        return None
    if len(_GLUED.findall(line)) > rules.symbol_share * n and sum(_GLUED.search(w) is not None for w in words) > rules.symbol_share * n:
        return "punctuation"
    if sum(w in _SEPARATORS for w in words) > rules.separator_share * n:
        return "navigation"
    if n >= 10 and Counter(words).most_common(1)[0][1] > rules.top_word_share * n:
        return "boilerplate"
    return None


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of five that occur at least twice; exact, by ranking pairs, then fours, then fives."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    two = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (int(two.max()) + 1) + two[2:], return_inverse=True)[1]
    five = four[:n] * (int(ids.max()) + 1) + ids[4:]
    _, inverse, count = np.unique(five, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judge_text(text: bytes, rules: LineRules) -> tuple[int, int, int, int, int, int, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words lost, cleaned text."""
    words = text.split()
    n = len(words)
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    codes = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((codes & 0xC0) != 0x80).sum())
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen: set[bytes] = set()
    kept, dup, lost = [], 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            repeat = line in seen
            seen.add(line)
            dup += repeat
            if repeat or line_fails(line, own, rules):
                lost += len(own)
                continue
        kept.append(line)
    return n, chars, symbols, dup, repeated_words(ids), lost, text if not lost else b"\n".join(kept)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words")


def _judge(rules: LineRules, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge_text(t or b"", rules) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(6)]
            n, repeat, lost = (np.array([g[i] for g in got], np.int64) for i in (0, 4, 5))
            failed = (n < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * n)
            cols += [pa.array(failed), pa.array(~failed & (lost <= rules.lost_share * n))]
            if with_text:
                cols.append(pa.array([g[6] for g in got], pa.binary()))
            names = [*batch.schema.names[:-1], *_COUNTS, "base_failed", "kept", *(["_clean"] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=names)

    return run


def judge_documents(df: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """key, the base counts, n_lost_words, base_failed, kept: one row per row of df; only key and text are read."""
    bounded_batches(df.sparkSession)
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean"
    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(_judge(rules, False), schema)


def clean_documents(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The kept rows of df with all its columns; failing lines are gone from text (and from n_chars, if there)."""
    bounded_batches(df.sparkSession, 4)
    fields = [f"`_c{i}` {k}" for i, (_, k) in enumerate(df.dtypes)]
    schema = ", ".join([*fields, *(f"{c} long" for c in _COUNTS), "base_failed boolean", "kept boolean", "_clean binary"])
    numbered = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    at = df.columns.index(text)
    names = [c for c in numbered.columns if c != f"_c{at}"]
    # The text crosses to Python once; of a text that is unchanged the same bytes come back.
    schema = ", ".join([*(f for i, f in enumerate(fields) if i != at), *(f"{c} long" for c in _COUNTS), "base_failed boolean", "kept boolean", "_clean binary"])
    judged = numbered.select(*names, F.col(f"_c{at}").cast("binary").alias("_text")).mapInArrow(_judge(rules, True), schema).filter("kept")
    out = []
    for i, c in enumerate(df.columns):
        value = F.col("_clean").cast("string") if i == at else F.col(f"_c{i}")
        if c == "n_chars":
            value = F.char_length(F.col("_clean").cast("string")).cast(df.schema[i].dataType)
        out.append(value.alias(c))
    return judged.select(*out)
