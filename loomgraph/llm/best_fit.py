"""Best-fit decreasing packing of whole documents with a segment tree over remaining capacities.

A document of up to `size` tokens stays whole; a longer one is cut from its end into pieces of `size`, so that only its first
piece is short. Pieces go longest first, each into the open sequence with the least room that still takes it: that sequence is
the leftmost open leaf at or after the piece's length in a segment tree over the `size` + 1 possible remainders, found in
log2(size) steps.

Best fit only looks at lengths, and sequences with the same room are alike. So the tree's leaves hold groups of sequences with
the same content, and a length is placed for all its pieces at once: the tightest sequence stays the tightest until it takes no
more of that length, hence each sequence of a group takes as many as fit before the next is touched, exactly as document by
document. Only the histogram of lengths, at most `size` numbers, comes to the driver. Its plan goes back as intervals of ranks,
which pieces find by their distributed rank within a length (`packing.pack_pieces`).

Defined cases: a null or empty text has the end id only; rows with a null key are documents too; repeated rows are documents
of their own, and which of two pieces equal in length, key and start goes where is open; an empty table gives an empty result;
very long texts are tokenized whole, by a batch bounded in bytes; columns besides key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .packing import Pattern, pack_pieces, token_pieces

SIZE, END_ID = 1024, 2


class CapacityTree:
    """Which remainders from 0 to `size` have an open sequence; a node says whether any leaf below it has one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        at = self.leaves + room
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least open remainder of at least `need`."""
        at = self.leaves + need
        while not self.open[at]:
            while at & 1:  # a right child: what lies further right hangs under an ancestor
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at + (not self.open[2 * at])
        return at - self.leaves


def best_fit_patterns(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """[(count, ((length, times), ...))]: the sequences that best-fit decreasing makes of the lengths."""
    tree, groups = CapacityTree(size), {room: [] for room in range(size + 1)}

    def put(room: int, count: int, content: tuple[tuple[int, int], ...]) -> None:
        if count:
            groups[room].append((count, content))
            tree.mark(room, True)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # new sequences, as many as are needed
                room = size
                count, content = -(-left // (size // length)), ()
            else:
                count, content = groups[room].pop()
                tree.mark(room, bool(groups[room]))
            fit = room // length
            full = min(count, left // fit)
            rest = min(left - full * fit, fit) if full < count else 0
            left -= full * fit + rest
            put(room - fit * length, full, (*content, (length, fit)))
            if rest:
                put(room - rest * length, 1, (*content, (length, rest)))
            put(room, count - full - bool(rest), content)
    return [g for room in groups for g in groups[room]]


def best_fit_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, tokenizer_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    pieces = materialize(token_pieces(df, key, text, size, tokenizer_path, ranks_path, with_ids, END_ID, short_first=True), "best-fit-pieces")
    packed = pack_pieces(pieces, size, (key, "start"), best_fit_patterns)
    discard(pieces)  # the ranked pieces are written
    nth = F.ceil(F.col("start") / size).cast("int")  # of all pieces but the first, each is full
    return packed.select(key, nth.alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
