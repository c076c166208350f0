"""Alignment of two tokenizers over the same bytes, by a sweep over the ends of their tokens.

A text with a leading space is encoded by A (a byte-level BPE) and B (a piece BPE with byte fallback). The byte offsets where both
have a token end cut the text into groups; every A token of a group is linked to every B token of it.

1. `end_events`: the ends of A's tokens and of B's, as the union of two kinds of rows. A row holds the ids whose tokens end in one stretch
   of WINDOW bytes; ends follow from the ids, as a token's bytes do.
2. The rows are dealt by document and sorted by offset within partitions; `Sweep` streams through them. Its state is the one open group (the
   tokens after the last common end) and the document at hand: counts, a SHA-256 in progress, its distinct pairs. Ends of a stretch of rows are
   met by a sorted search, not one by one.
3. The pairs of a block of whole documents become rows (block, pair, documents that hold it) and, for the documents, positions in the block's sorted pairs.
   Blocks are bounded in pairs, but for a single document with more, whose own text bounds them. Counts are sums over blocks, so that the pair
   that every document holds is one row a block, not one a document.
4. Each block gets back the counts of its own pairs, and whether they are the highest of their A id, by a shuffle join; only the highest count
   by A id, a table no longer than A's vocabulary, is broadcast.

Defined cases: a row is a document, also when its key is null or repeated; a text that is null, empty or whose tokens do not spell it
(B reads U+2581 as a space) has no tokens: zeros and an empty groups_sha256; strings of special tokens are plain text; an empty table
gives an empty result; very long texts are tokenized whole and swept by stretches; columns besides key and text are not read, and
rows are numbered by their place in df, which must come from files (a task that runs again numbers them alike).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, temporary_tables

#: Bytes of text whose ends are one event row; tokens swept at a time; distinct (document, pair) of a block.
WINDOW, STEP, BLOCK = 1 << 16, 1 << 20, 1 << 20
SIDE_A, SIDE_B = 0, 1
#: Words whose pieces a task remembers; then it starts anew.
MEMORY = 200_000


class Ends:
    """Text -> ids, and id -> bytes, of one tokenizer."""

    token: list[bytes]

    def __call__(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


class ByteLevel(Ends):
    """Space + text by the byte-level BPE. Its ranks give the ids of plain letters up to Cyrillic, the tokenizer file those of the rest."""

    UNSAFE = re.compile(r"[^\x00-ӿ]|\S{1000}|\s{1000}")

    def __init__(self, tokenizer_path: str, ranks_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        letters = byte_letters()
        self.token = [bytes(letters.get(c, 0) for c in self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())]

    def __call__(self, text: str) -> np.ndarray:
        text = " " + text
        if self.UNSAFE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte -> the byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20,)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pieces(Ends):
    """Text by the piece BPE, which adds the space itself.

    No piece goes on with a space mark after another letter (this is tested), so merges stay within a run of spaces and the word
    after it, and such words are encoded once and remembered.
    """

    WORDS = re.compile(r" +[^ ]*")

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.mark = self.model.piece_to_id("▁")
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str) -> np.ndarray:
        if not self.apart or "▁" in text:
            return np.array(self.model.encode(text), "<u4")
        out: list[int] = []
        known = self.known
        for word in self.WORDS.findall(" " + text):
            ids = known.get(word)
            if ids is None:
                ids = self.model.encode(word[1:]) if len(word) > 1 else [self.mark]
                if len(word) <= 40:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[word] = ids
            out += ids
        return np.array(out, "<u4")


def lengths(side: Ends) -> np.ndarray:
    return np.array([len(t) for t in side.token], np.int64)


def packed(values: np.ndarray, kind: str) -> bytes:
    raw = np.ascontiguousarray(values, kind).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), kind)


def narrowest(side: Ends) -> str:
    return "<u2" if len(side.token) <= 1 << 16 else "<u4"


def end_events(docs: DataFrame, key: str, text: str, sides: Callable[[], tuple[Ends, Ends]]) -> DataFrame:
    """row, stretch, side, key, ids: the tokens of each side that end in each stretch of bytes; a document without tokens is one row of A without ids."""
    bounded_batches(docs.sparkSession, 4)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))

    def rows_of(text: bytes | None, both: tuple[Ends, Ends], long: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
        said = (text or b"").decode("utf-8", "replace")
        ids = [side(said) for side in both] if said else []
        whole = b" " + (text or b"")
        if not said or any(side.spelled(i) != whole for side, i in zip(both, ids, strict=True)):
            yield 0, SIDE_A, b""
            return
        for side, (own, mine) in enumerate(zip(ids, both, strict=True)):
            at = (np.cumsum(long[side][own]) - 1) // WINDOW
            cuts = np.flatnonzero(np.diff(at, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
                yield int(at[a]), side, packed(own[a:b], narrowest(mine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides()
        long = lengths(both[0]), lengths(both[1])
        for batch in batches:
            number, found = [], []
            for i, one in enumerate(batch.column(2)):
                for x in rows_of(one.as_py(), both, long):
                    number.append(i), found.append(x)
            stretch, side, ids = zip(*found, strict=True) if found else ((), (), ())
            at = pa.array(number, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(stretch, pa.int32()), pa.array(side, pa.int8()), batch.column(1).take(at), pa.array(ids, pa.binary())], names=["row", "stretch", "side", "key", "ids"])

    return numbered.mapInArrow(run, f"row long, stretch int, side byte, key {dict(numbered.dtypes)['key']}, ids binary")


class Sweep:
    """Rows of events in order -> blocks of documents, their counts and pairs."""

    def __init__(self, both: tuple[Ends, Ends], block: int = BLOCK, step: int = STEP):
        self.long = lengths(both[0]), lengths(both[1])
        self.kind = narrowest(both[0]), narrowest(both[1])
        self.n_b, most = len(both[1].token), max(len(s.token) for s in both)
        self.bits = int(len(both[0].token) * self.n_b - 1).bit_length()
        #: Ids as text, with what stands before them: nothing, a comma, a bar (first B id of a group), a semicolon (first A id of a later one).
        self.names = [mark + b"%d" % i for mark in (b"", b",", b"|", b";") for i in range(most)]
        self.most, self.block, self.step = most, block, step
        none = np.zeros(0, np.int64)
        self.ids = [[none], [none]]  # of each side: tokens not yet swept
        self.docs = [[none], [none]]  # and their documents, numbered within the block
        self.waiting = 0
        self._new_block()

    def _new_block(self) -> None:
        self.keys: list = []
        self.totals = np.zeros((4, 0), np.int64)  # n_a, n_b, n_groups, n_links by document
        self.hashes: list = []
        self.pairs: list[np.ndarray] = []  # document and pair in one number
        self.times: list[np.ndarray] = []
        self.n_pairs = 0

    def document(self, key: object) -> tuple | None:
        """A new document begins; gives the block that ends with the one before it, if it is full."""
        out = None
        if self.waiting >= self.step or self.n_pairs >= self.block:
            self._sweep()
            if self.n_pairs >= self.block:
                out = self.close()
        self.keys.append(key), self.hashes.append(None)
        return out

    def events(self, side: int, ids: bytes) -> None:
        own = unpacked(ids, self.kind[side]).astype(np.int64)
        self.ids[side].append(own), self.docs[side].append(np.full(len(own), len(self.keys) - 1, np.int64))
        self.waiting += len(own)
        if self.waiting >= 4 * self.step:  # one document of many stretches
            self._sweep()

    def _sweep(self) -> None:
        """Close all groups that end within the tokens at hand; those after the last common end wait."""
        (a, b), (doc_a, doc_b) = ([np.concatenate(x) for x in side] for side in (self.ids, self.docs))
        end_a, end_b = np.cumsum(self.long[0][a]), np.cumsum(self.long[1][b])
        at = np.searchsorted(end_b, end_a)
        meet = np.flatnonzero((at < len(b)) & (end_b[np.minimum(at, len(b) - 1)] == end_a)) if len(b) else np.zeros(0, np.int64)
        upto_a, upto_b = (meet[-1] + 1, at[meet[-1]] + 1) if len(meet) else (0, 0)
        self.ids, self.docs = [[a[upto_a:]], [b[upto_b:]]], [[doc_a[upto_a:]], [doc_b[upto_b:]]]
        self.waiting = len(a) - upto_a + len(b) - upto_b
        if len(meet):
            self._groups(a[:upto_a], b[:upto_b], meet + 1, at[meet] + 1, doc_a[meet])

    def _groups(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, doc: np.ndarray) -> None:
        """Groups end before stop_a in a and stop_b in b; doc is each group's document."""
        start_a, start_b = np.concatenate([[0], stop_a[:-1]]), np.concatenate([[0], stop_b[:-1]])
        n_a, n_b = stop_a - start_a, stop_b - start_b
        links, n = n_a * n_b, len(self.keys)
        grown = np.zeros((4, n), np.int64)
        grown[:, : self.totals.shape[1]] = self.totals
        for row, what in zip(grown, (n_a, n_b, np.ones_like(n_a), links), strict=True):
            np.add.at(row, doc, what)
        self.totals = grown

        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        mark = np.ones(len(a) + len(b), np.int64)
        place_a, place_b = np.arange(len(a)) + start_b[group_a], np.arange(len(b)) + stop_a[group_b]
        mark[place_b[start_b]] = 2
        mark[place_a[start_a]] = 3
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        for g in begins:
            if self.hashes[doc[g]] is None:
                self.hashes[doc[g]], mark[place_a[start_a[g]]] = hashlib.sha256(), 0
        spelled = np.empty(len(mark), np.int64)
        spelled[place_a], spelled[place_b] = a, b
        text = list(map(self.names.__getitem__, (mark * self.most + spelled).tolist()))
        cuts = [*(start_a + start_b)[begins].tolist(), len(text)]
        for k, g in enumerate(begins):
            self.hashes[doc[g]].update(b"".join(text[cuts[k] : cuts[k + 1]]))

        many = links > 4096  # their distinct ids are paired, not their tokens
        repeat = np.where(many, 0, n_b)[group_a]
        left = np.repeat(np.arange(len(a)), repeat)
        right = start_b[group_a][left] + np.arange(len(left)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        self._add((doc[group_a][left] << self.bits) | (a[left] * self.n_b + b[right]), None)
        for g in np.flatnonzero(many):
            (x, nx), (y, ny) = (np.unique(v, return_counts=True) for v in (a[start_a[g] : stop_a[g]], b[start_b[g] : stop_b[g]]))
            for i, times in zip(x, nx, strict=True):
                self._add((doc[g] << self.bits) | (i * self.n_b + y), times * ny)

    def _add(self, pairs: np.ndarray, times: np.ndarray | None) -> None:
        pairs, at, n = np.unique(pairs, return_inverse=True, return_counts=True)
        self.pairs.append(pairs)
        self.times.append(n if times is None else np.bincount(at, times, len(pairs)).astype(np.int64))
        self.n_pairs += len(pairs)
        if self.n_pairs >= 4 * self.block:
            self._fold()

    def _fold(self) -> None:
        """Pairs of a document that several sweeps have found become one."""
        every, times = np.concatenate([np.zeros(0, np.int64), *self.pairs]), np.concatenate([np.zeros(0, np.int64), *self.times])
        order = np.argsort(every, kind="stable")
        every, times = every[order], times[order]
        first = np.flatnonzero(np.diff(every, prepend=-1))
        self.pairs, self.times = [every[first]], [np.add.reduceat(times, first) if len(first) else times]
        self.n_pairs = len(first)

    def close(self) -> tuple | None:
        """keys, totals, hashes, sorted pairs, documents that hold each, pairs by document, positions among the pairs, times: the block at hand."""
        self._sweep()
        if not self.keys:
            return None
        self._fold()
        every, times = self.pairs[0], self.times[0]
        doc, pair = every >> self.bits, every & ((1 << self.bits) - 1)
        known, position, held = np.unique(pair, return_inverse=True, return_counts=True)
        totals = np.zeros((4, len(self.keys)), np.int64)
        totals[:, : self.totals.shape[1]] = self.totals
        out = self.keys, totals, [h.hexdigest() if h else "" for h in self.hashes], known, held, np.bincount(doc, minlength=len(self.keys)), position, times
        self._new_block()
        return out


#: Columns of blocks; the key has the type that it has in the documents.
BLOCKS = "block long, docs array<struct<key: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, n_pairs: long>>, pairs array<long>, held array<long>, positions binary, times binary"


def swept(events: DataFrame, sides: Callable[[], tuple[Ends, Ends]]) -> DataFrame:
    """Blocks of documents: BLOCKS, with a number of its own for each."""
    kind = dict(events.dtypes)["key"]
    in_order = events.repartition("row").sortWithinPartitions("row", "stretch", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sweep, last, n, key_type = Sweep(sides()), None, TaskContext.get().partitionId() << 33, pa.null()

        def record(block: tuple | None) -> Iterator[pa.RecordBatch]:
            nonlocal n
            if block is None:
                return
            keys, totals, hashes, pairs, held, per, position, times = block
            # Positions of a document rise: steps between them are small numbers.
            steps = np.diff(position, prepend=0)
            first = (np.cumsum(per) - per)[per > 0]
            steps[first] = position[first]
            docs = pa.StructArray.from_arrays([pa.array(keys, key_type), *map(pa.array, totals), pa.array(hashes, pa.string()), pa.array(per.astype(np.int64))], ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([n]), one(docs), one(pa.array(pairs)), one(pa.array(held.astype(np.int64))), pa.array([packed(steps, "<u4")], pa.binary()), pa.array([packed(times, "<u4")], pa.binary())], names=["block", "docs", "pairs", "held", "positions", "times"])
            n += 1

        for batch in batches:
            key_type = batch.schema.field(3).type
            for row, _, side, key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != last:
                    yield from record(sweep.document(key))
                    last = row
                if ids:
                    sweep.events(side, ids)
        yield from record(sweep.close())

    return in_order.mapInArrow(run, BLOCKS.format(kind=kind))


def scored(blocks: DataFrame, n_b: int) -> DataFrame:
    """block, pairs (position, count, is_best): how many documents of the corpus hold each pair of the block, and whether no pair of its A id is in more."""
    own = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("position", "p")).select("block", "position", "p.pairs", "p.held")
    counts = own.groupBy("pairs").agg(F.sum("held").alias("count")).withColumn("a", F.expr(f"pairs div {n_b}"))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))  # no more rows than A has ids
    counts = counts.join(F.broadcast(best), "a").select("pairs", "count", (F.col("count") == F.col("most")).alias("is_best"))
    return own.join(counts, "pairs").groupBy("block").agg(F.collect_list(F.struct("position", "count", "is_best")).alias("scores"))  # bounded as a block is


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _with_scores(blocks: DataFrame, scores: DataFrame, key: str, kind: str) -> DataFrame:
    """One row a document."""
    both = blocks.drop("pairs", "held").join(scores, "block", "left").select("docs", "positions", "times", "scores")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, scores = (batch.column(c).slice(i, 1).flatten() for c in (0, 3))
                of = lambda f, t=docs: t.field(f) if t.offset == 0 else t.flatten()[t.type.get_field_index(f)]
                count, best = np.zeros(len(scores), np.int64), np.zeros(len(scores), bool)
                if len(scores):
                    at = of("position", scores).to_numpy()
                    count[at], best[at] = of("count", scores).to_numpy(), of("is_best", scores).to_numpy(zero_copy_only=False)
                steps, times, per = unpacked(batch.column(1)[i].as_py(), "<u4").astype(np.int64), unpacked(batch.column(2)[i].as_py(), "<u4").astype(np.int64), of("n_pairs").to_numpy()
                start = np.cumsum(per) - per
                run_up = np.cumsum(steps)
                before = np.concatenate([[0], run_up])[start]
                position = run_up - np.repeat(before, per)
                total = lambda x, start=start, per=per: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([start, [per.sum()]])])
                columns = [of("key"), *(of(c) for c in ALIGNED[:4]), pa.array(total(times * best[position])), pa.array(total(times * count[position])), of("groups_sha256")]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *ALIGNED])

    return both.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in ALIGNED[:-1]) + ", groups_sha256 string")


def align_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """One row per document: key and ALIGNED."""
    a = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    b = model_path or public_tokenizers.path("piece_bpe_32k.model")
    sides = lambda: (ByteLevel(*a), Pieces(b))
    with temporary_tables() as keep:
        blocks = keep(materialize(swept(end_events(docs, key, text, sides), sides), "alignment-blocks"))
        return _with_scores(blocks, scored(blocks, len(Pieces(b).token)), key, dict(docs.dtypes)[key])


def aligned_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """key, place, start, stop, a_ids, b_ids: the groups themselves, byte offsets in space + text; a row may be long where ends do not meet.

    Nothing is dealt anew: each text is swept where it is encoded.
    """
    a = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    b = model_path or public_tokenizers.path("piece_bpe_32k.model")
    bounded_batches(docs.sparkSession, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = ByteLevel(*a), Pieces(b)
        long = lengths(both[0]), lengths(both[1])
        for batch in batches:
            for i, one in enumerate(batch.column(1)):
                raw = one.as_py() or b""
                ids = [side(raw.decode("utf-8", "replace")) for side in both] if raw else []
                if not raw or any(side.spelled(x) != b" " + raw for side, x in zip(both, ids, strict=True)):
                    continue
                ends = [np.cumsum(n[x]) for n, x in zip(long, ids, strict=True)]
                stop, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at + 1]), pa.int32()), pa.array(x.astype(np.int32))) for at, x in ((at_a, ids[0]), (at_b, ids[1]))]
                n = len(stop)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, i))), pa.array(np.arange(n)), pa.array(np.concatenate([[0], stop[:-1]])), pa.array(stop), *lists], names=[key, "place", "start", "stop", "a_ids", "b_ids"])

    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, place long, start long, stop long, a_ids array<int>, b_ids array<int>")
