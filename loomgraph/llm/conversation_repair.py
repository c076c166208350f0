"""Repair of conversations: a forward Viterbi pass over each one, with four grammar states.

The role initials of a repaired conversation read `(s?(ua)+)?`. The states are: nothing said yet, after s, after u, after a; the
first and the last may end. Each row is kept (0), gets the role user or assistant instead (2) or is deleted (3, the only edit
for a blank or repeated row); a truncated row that stays adds 1; empty user and assistant rows can be inserted anywhere (2
each). Of the cheapest repairs the one counts whose edits' initials are least in ASCII order.

A state holds the least (cost, audit) that leads to it. Each row closes its layer with insertions: two in a row reach every state that
insertions can reach, so no more are ever needed. An audit is carried as its rank among the layer's audits and a link back of one
byte: audits that end with a row's own edit never begin one another (what follows would be insertions only, and no audit ends
with them), so ranks and the letters of the next edit order what they become. The repaired text is carried as a SHA-256 in
progress, copied where ways part. A conversation therefore costs four bytes a row and no text, however long it is.

Rows come sorted from Spark: repartition by conversation, sortWithinPartitions on turn. A hash over a conversation's repaired rows is
sequential by nature, so one conversation is one task's; it streams through. Whether a row's role and text were there before is
not kept in that task: the first turn of each (role, text) is an aggregate with partial sums, whose rows are sorted in before the row
they speak of.

Defined cases: nulls are one space in every column, but null turns come first and do not count for gaps; rows with a null key are
one conversation; rows of one turn go by role, then by the SHA-256 of their text; roles that start with none of s, u and a cannot
be kept; an empty table gives an empty result; texts may be of any length, in batches bounded in bytes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

START, S, U, A = range(4)
#: State -> role initial -> state.
NEXT = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
ROLES = {"u": "user", "a": "assistant"}
SPACE, ENDS = b" \t\n\v\f\r", b".!?"
#: Kinds of sorted rows: a conversation that may have lost all rows, the first turn of a (role, text), a row.
SEEN, FIRST, ROW = range(3)


def _insertions() -> tuple[tuple[tuple[int, str], ...], ...]:
    """For each state, the states within two insertions and the initials inserted."""
    out = []
    for state in range(4):
        found = {state: ""}
        for n in (1, 2):
            for initials in map("".join, product("ua", repeat=n)):
                at: int | None = state
                for c in initials:
                    at = NEXT[at].get(c) if at is not None else None
                if at is not None:
                    found.setdefault(at, initials)
        out.append(tuple(found.items()))
    return tuple(out)


INSERTIONS = _insertions()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(conv_id:turn) picks; a dropped row leaves its conv_id, with `gone` true."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), what.alias("_d"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_d") <= 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_d") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1))).alias("_c")).drop("_c")


def sorted_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """The rows and what the sweep must know before each, dealt by conversation and sorted: conv, turn, role, text, digest, kind."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    is_gone: Column = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), is_gone.alias("gone"))
    plain = plain.withColumn("digest", F.unhex(F.sha2("text", 256)))
    said = plain.filter("not gone")
    firsts = said.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("f"))
    every = said.select("conv", "turn", "role", F.col("text").cast("binary").alias("text"), "digest", F.lit(ROW).alias("kind"))
    every = every.unionByName(firsts.select("conv", F.col("f.turn").alias("turn"), "role", "digest", F.lit(FIRST).alias("kind")), allowMissingColumns=True)
    every = every.unionByName(plain.filter("gone").select("conv", F.lit(SEEN).alias("kind")), allowMissingColumns=True)
    return every.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.expr("kind > 0"), F.asc_nulls_first("turn"), "role", "digest", "kind")


class Repair:
    """One conversation, row by row: its faults, and the four least ways so far."""

    def __init__(self) -> None:
        self.rows = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns = [None, None, 0]  # least, greatest, distinct
        self.first: tuple[str, bytes] | None = None  # the (role, digest) that the next row is the first of
        self.initial: str | None = None
        #: State -> cost, rank, SHA-256 of the repaired rows, for the ways that end with a row's own edit.
        self.ways = {START: (0, 0, hashlib.sha256())}
        self.links = bytearray()

    def fault(self, role: str, digest: bytes, text: bytes) -> str | None:
        is_first, self.first = self.first == (role, digest), None
        last = text.rstrip(SPACE)[-1:]
        if not last:
            return "blank"
        if not is_first:
            return "duplicate"
        return None if last in ENDS else "truncated"

    def add(self, turn: int | None, role: str, digest: bytes, text: bytes) -> None:
        fault, initial = self.fault(role, digest, text), role[:1]
        self.rows += 1
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            low, high, n = self.turns
            self.turns = [turn if low is None else low, turn, n + (turn != high)]
        self._layer(role, initial, text, fault)

    def _layer(self, role: str, initial: str, text: bytes, fault: str | None) -> None:
        best: dict[int, tuple] = {}
        late = fault == "truncated"
        for start, (cost, rank, _) in self.ways.items():
            for at, inserted in INSERTIONS[start]:
                paid, edits = cost + 2 * len(inserted), "I" * len(inserted)
                options = [(at, paid + 3, "D", "")]
                if fault in (None, "truncated"):
                    if (to := NEXT[at].get(initial)) is not None:
                        options.append((to, paid + late, "K", role))
                    options += [(to, paid + 2 + late, "R", ROLES[c]) for c, to in NEXT[at].items() if c in ROLES]
                for to, total, letter, said in options:
                    way = (total, rank, edits + letter, start, inserted, said)
                    if to not in best or way[:3] < best[to][:3]:
                        best[to] = way
        ranks = {to: n for n, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        ways, links = {}, bytearray(4)
        for to, (cost, _, edits, start, inserted, said) in best.items():
            written = self._written(start, inserted)
            if said:
                written.update((b"" if start == START and not inserted else b"\n") + said.encode() + b":" + text)
            ways[to] = (cost, ranks[to], written)
            links[to] = start | (len(edits) - 1) << 2 | "DKR".index(edits[-1]) << 4
        self.ways = ways
        self.links += links

    def _written(self, start: int, inserted: str):
        out = self.ways[start][2].copy()
        for n, c in enumerate(inserted):
            out.update((b"" if start == START and not n else b"\n") + ROLES[c].encode() + b":")
        return out

    def done(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"""
        ends = [(cost + 2 * len(inserted), rank, "I" * len(inserted), start, inserted) for start, (cost, rank, _) in self.ways.items() for at, inserted in INSERTIONS[start] if at in (START, A)]
        cost, _, tail, at, inserted = min(ends)
        digest, edits = self._written(at, inserted).hexdigest(), [tail]
        for layer in range(self.rows - 1, -1, -1):
            link = self.links[4 * layer + at]
            edits.append("I" * (link >> 2 & 3) + "DKR"[link >> 4])
            at = link & 3
        low, high, n = self.turns
        return (high - low + 1 - n if n else 0, *self.faults.values(), self.illegal, cost, "".join(reversed(edits)), digest)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COLUMNS = [c.split()[0] for c in REPORT.split(", ")]


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row per conversation: its key and REPORT. Rows with `gone` true only name their conversation."""
    bounded_batches(rows.sparkSession)
    kind = dict(rows.dtypes)[conv]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            keys, found = [], []
            for k, turn, role, text, digest, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or k != key:
                    if now is not None:
                        keys.append(key), found.append(now.done())
                    key, now = k, Repair()
                if kind == FIRST:
                    now.first = role, digest
                elif kind == ROW:
                    now.add(turn, role, digest, text)
            if found:
                yield _batch(keys, found, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if now is not None:
            yield _batch([key], [now.done()], last)

    def _batch(keys: list, found: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))], names=[conv, *COLUMNS])

    return sorted_rows(rows, conv, turn, role, text, gone).mapInArrow(run, f"`{conv}` {kind}, {REPORT}")


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The repaired conversations: conv, place (from 0), role, text, edit (K, R or I). Audits are sorted in before the rows that they edit."""
    report = repair_conversations(rows, conv, turn, role, text, gone)
    kind = dict(rows.dtypes)[conv]
    plain = sorted_rows(rows, conv, turn, role, text, gone).filter(F.col("kind") == ROW)
    both = plain.select("conv", "turn", "role", "text", "digest", "kind").unionByName(report.select(F.col(conv).alias("conv"), F.col("audit").cast("binary").alias("text"), F.lit(SEEN).alias("kind")), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.expr("kind > 0"), F.asc_nulls_first("turn"), "role", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = state = at = 0
        audit = ""

        def said(out: list, key: object, role: str, text: str, edit: str) -> None:
            nonlocal place, state, at
            out.append((key, place, role, text, edit))
            place, at, state = place + 1, at + 1, NEXT[state][role[:1]]

        for batch in batches:
            out: list[tuple] = []
            for k, _, role, text, _, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == SEEN:
                    audit, place, state, at = text.decode(), 0, START, 0
                elif audit[at] == "D":
                    at += 1
                else:
                    said(out, k, ROLES["a" if state == U else "u"] if audit[at] == "R" else role, text.decode(), audit[at])
                while audit[at : at + 1] == "I":
                    said(out, k, ROLES["a" if state == U else "u"], "", "I")
            columns = zip(*out, strict=True) if out else [()] * 5
            types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[conv, "place", "role", "text", "edit"])

    return both.mapInArrow(run, f"`{conv}` {kind}, place long, role string, text string, edit string")


def repair_damage(conversations: DataFrame) -> DataFrame:
    """The report of conversations after damaged()."""
    return repair_conversations(damaged(conversations), gone="gone")
