"""Packing token sequences with little padding: shortest-pack-first over the length histogram.

A document's ids (a byte-level BPE, then one end id) are cut at `size` tokens; each piece has a length. Only the histogram
of lengths (at most `size` rows, an aggregate) reaches the driver. There lengths are placed longest first, each into the
shortest pack that still has room, for whole groups of equal packs at a time: a group is a packing pattern with a count, and
placing n pieces of a length changes counts and splits at most one group. So there are at most 2 `size` patterns whatever
the corpus. A pattern gives each of its lengths an interval of ranks; the pieces of a length are ranked in a distributed sort
(`common.ranked`, so that a length that very many pieces share spreads over partitions) and joined to these intervals, a
table with a bound by `size` alone. Texts and ids stay in the tasks that tokenize; what moves is one small row per piece.

Defined cases: a null or empty text has the end id only; rows with a null key are documents too; repeated rows are documents
of their own, and which of two pieces equal in length, key and start goes where is open (they spread over tasks); an empty
table gives an empty result; very long texts are tokenized whole, by a batch bounded in bytes; columns besides key and text are not read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, ranked

SIZE, END_ID = 2048, 1
#: A count of packs with the same content ((length, times), ...).
Pattern = tuple[int, tuple[tuple[int, int], ...]]
_UNSAFE = re.compile(r"[^\x00-\u04ff]|\S{1000}|\s{1000}")


class Ids:
    """Text -> ids as little-endian 32-bit bytes, those of the public tokenizer file.

    The same vocabulary is also shipped as ranks for tiktoken, which gives the same ids several times as fast; texts in
    letters up to Cyrillic without very long runs go that way. Others, where two libraries may know different Unicode
    tables or slow down, go through the tokenizer file itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        marks = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self.slow(text)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def token_pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, tokenizer_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False, end_id: int = END_ID, short_first: bool = False
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens (and ids, if asked for). Of a document's pieces the last is short, or the first."""
    bounded_batches(df.sparkSession)
    paths = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(*paths)
        for batch in batches:
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                all_ids = ids_of((raw or b"").decode("utf-8", "replace")) + end
                first = (len(all_ids) - 4) % (4 * size) + 4 if short_first else 4 * size
                for upto in range(first, len(all_ids) + 4 * size, 4 * size):
                    at = max(0, upto - 4 * size)
                    piece = all_ids[at:upto]
                    rows.append(i), start.append(at // 4), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(len(all_ids) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            out = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            out += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(out, names=[key, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    schema = f"`{key}` {dict(df.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)


def packing_patterns(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """[(count, ((length, times), ...))]: packs with the same content, lengths falling.

    Longest length first; each length goes to the shortest packs with room, else to new ones, filled with as many of the
    length as fit.
    """
    groups: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)  # by tokens used
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for used in sorted(u for u in groups if u + length <= size):
            fit = (size - used) // length
            for count, content in groups.pop(used):
                full, rest = min(count, left // fit), 0
                left -= full * fit
                if full < count and left:  # one more pack of this group takes what is left
                    rest, left = left, 0
                for n, times in ((full, fit), (1 if rest else 0, rest), (count - full - bool(rest), 0)):
                    if n:
                        groups[used + times * length].append((n, (*content, (length, times)) if times else content))
            if not left:
                break
        if left:
            fit = size // length
            if left // fit:
                groups[fit * length].append((left // fit, ((length, fit),)))
            if left % fit:
                groups[left % fit * length].append((1, ((length, left % fit),)))
    return [g for used in sorted(groups, reverse=True) for g in groups[used]]


def rank_intervals(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, packs, offset) for each length of each pattern; ranks from 1."""
    taken: dict[int, int] = defaultdict(int)
    sequence, out = 0, []
    for count, content in patterns:
        offset = 0
        for length, times in content:
            first = taken[length] + 1
            taken[length] += count * times
            out.append((length, first, taken[length], sequence, count, offset))
            offset += length * times
        sequence += count
    return out


def pack_pieces(pieces: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "start"), plan: Callable[[dict[int, int], int], list[Pattern]] | None = None) -> DataFrame:
    """pieces (a written table with a column length) and their sequence_id and offset; plan makes patterns of the histogram of lengths."""
    spark = pieces.sparkSession
    placed = ranked(pieces, "length", list(order), "packing")
    histogram = {r[0]: r[1] for r in placed.groupBy("length").count().collect()}
    intervals = rank_intervals((plan or packing_patterns)(histogram, size))
    if len(intervals) > 64 * size * 2:  # distinct lengths in a pack times patterns, by construction
        raise AssertionError("more packing intervals than their bound")
    table = spark.createDataFrame(intervals, "_length long, _from long, _to long, _first long, _packs long, _offset long")
    joined = placed.join(F.broadcast(table), (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("_from"), F.col("_to")))
    nth = F.col("rank") - F.col("_from")
    joined = joined.withColumns({"sequence_id": F.col("_first") + nth % F.col("_packs"), "offset": F.col("_offset") + F.expr("(rank - _from) div _packs") * F.col("length")})
    return joined.drop("rank", "_length", "_from", "_to", "_first", "_packs", "_offset")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, tokenizer_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    pieces = materialize(token_pieces(df, key, text, size, tokenizer_path, ranks_path, with_ids), "packing-pieces")  # the range sort reads them twice
    packed = pack_pieces(pieces, size, (key, "start"))
    discard(pieces)  # the ranked pieces are written
    return packed.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
