"""Token alignment, best-fit packing and conversation repair against brute force, on odd rows, repeated rows, null keys, empty tables and clashing columns."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import best_fit, conversation_repair, packing, token_alignment

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, `key` string, `row` int, piece string, `length` int, side int"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "one two"), (5, "one two"), (None, "a row without a key."), (None, "a row without a key."), (None, None), (6, "<|endoftext|> is <s> text </s> <unk> <0x41>"), (7, "mark ▁ of a space"),
    (8, "Ünï cödé 漢字かな \U0001f600 é \x00\x7f"), (9, "a" * 300_000), (10, "=-" * 60_000 + "x"), (11, "漢字éx" * 20_000), (12, "word " * 1023), (13, " ".join(f"w{i}" for i in range(3000))), (14, "  two  spaces  "),
]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """The smallest documents and the odd ones, with columns that the operators use as names of their own; read from files."""
    at = str(tmp_path_factory.mktemp("documents"))
    odd = spark.createDataFrame([(k, t, "k", 3, "p", 4, 5) for k, t in ODD], DOCS)
    clash = [F.lit(v).cast(t).alias(n) for v, t, n in (("k", "string", "key"), (3, "int", "row"), ("p", "string", "piece"), (4, "int", "length"), (5, "int", "side"))]
    spark.read.parquet(f"{DIR}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", *clash).unionByName(odd).write.parquet(f"{at}/d")
    return spark.read.parquet(f"{at}/d")


A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def both_tokens(text):
    letters = token_alignment.byte_letters()
    if not text:
        return [], []
    a = A.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    two = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, B.id_to_piece(i)) for i in B.encode(text))]
    spelled = (" " + text).encode()
    return (one, two) if all(b"".join(x for _, x in side) == spelled for side in (one, two)) else ([], [])


def groups_of(text):
    one, two = both_tokens(text)
    ends = []
    for side in (one, two):
        at, found = 0, {}
        for n, (_, x) in enumerate(side):
            at += len(x)
            found[at] = n + 1
        ends.append(found)
    out, i, j = [], 0, 0
    for e in sorted(ends[0].keys() & ends[1].keys()):
        out.append(([x for x, _ in one[i : ends[0][e]]], [x for x, _ in two[j : ends[1][e]]]))
        i, j = ends[0][e], ends[1][e]
    assert (i, j) == (len(one), len(two))
    return out


def aligned(texts):
    """What the contract says for each text, in order."""
    every, hold = [], Counter()
    for text in texts:
        groups, links = groups_of(text), Counter()
        for x, y in groups:
            nx, ny = Counter(x), Counter(y)
            for i in nx:
                for j in ny:
                    links[i, j] += nx[i] * ny[j]
        hold.update(links.keys())
        every.append((groups, links))
    most = Counter()
    for (a, _), n in hold.items():
        most[a] = max(most[a], n)
    out = []
    for groups, links in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for p, n in links.items() if hold[p] == most[p[0]]), sum(n * hold[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_alignment_equals_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    want = sorted([(r.doc_id, *w) for r, w in zip(rows, aligned([r.text for r in rows]), strict=True)], key=repr)
    got = sorted(map(tuple, token_alignment.align_documents(documents).collect()), key=repr)
    assert got == want
    assert token_alignment.align_documents(documents.limit(0)).count() == 0


def test_alignment_groups(documents):
    few = documents.filter("doc_id < 1000 and doc_id not in (9, 10, 11, 5)")
    got = defaultdict(list)
    for r in token_alignment.aligned_groups(few).orderBy("doc_id", "place").collect():
        got[r.doc_id].append((r.a_ids, r.b_ids))
    for r in few.collect():
        assert got[r.doc_id] == groups_of(r.text)


def sides():
    return token_alignment.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")), token_alignment.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_words_are_encoded_as_in_their_text():
    a, b = sides()
    rng = random.Random(3)
    letters = list("ab e  th\n\t<s>_|.,;'0129éßжд漢字\U0001f600▁ ́\x00\x7fﬁ")
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        assert a(text).tolist() == A.encode(" " + text, add_special_tokens=False).ids and b(text).tolist() == B.encode(text)


@pytest.mark.parametrize("stretch,step,block", [(7, 5, 3), (64, 40, 1000), (1 << 16, 1 << 20, 40)])
def test_sweep_in_stretches_and_blocks_of_any_size(documents, stretch, step, block):
    """The same groups, links and counts, however the events are cut; blocks end between documents."""
    a, b = both = sides()
    texts = [r.text for r in documents.filter("doc_id is null or doc_id not in (9, 10, 11)").limit(60).collect()] + ["ab" * 3000, "漢字éx" * 500]
    sweep, blocks = token_alignment.Sweep(both, block, step), []
    for n, text in enumerate(texts):
        blocks.append(sweep.document(n))
        if not both_tokens(text)[0]:
            continue
        parts = []
        for side, (own, ids) in enumerate(zip(both, (a(text), b(text)), strict=True)):
            at = (np.cumsum(token_alignment.lengths(own)[ids]) - 1) // stretch
            parts += [(k, side, ids[at == k]) for k in np.unique(at)]
        for _, side, ids in sorted(parts, key=lambda p: p[:2]):
            sweep.events(side, token_alignment.packed(ids, token_alignment.narrowest(both[side])))
    blocks = [x for x in [*blocks, sweep.close()] if x]
    hold = Counter()
    for _, _, _, pairs, held, *_ in blocks:
        hold.update(dict(zip(pairs.tolist(), held.tolist(), strict=True)))
    most = Counter()
    for p, n in hold.items():
        most[p // len(b.token)] = max(most[p // len(b.token)], n)
    got = []
    for keys, totals, hashes, pairs, _, per, position, times in blocks:
        at = 0
        for i in range(len(keys)):
            own = [(pairs[p], n) for p, n in zip(position[at : at + per[i]], times[at : at + per[i]], strict=True)]
            at += per[i]
            got.append((*totals[:, i].tolist(), sum(n for p, n in own if hold[p] == most[p // len(b.token)]), sum(n * hold[p] for p, n in own), hashes[i]))
    assert got == aligned(texts)
    assert block > 999 or step > 999 or len(blocks) > 3


def naive_best_fit(lengths, size):
    """Room left in each sequence, document by document."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else size
        bisect.insort(rooms, room - n)
    return Counter(rooms)


def test_best_fit_is_that_of_single_documents():
    rng = random.Random(5)
    for t in range(600):
        size = rng.choice([1, 2, 7, 16, 31, 64, 100])
        lengths = [min(size, max(1, int(rng.expovariate(5 / size)))) if t % 3 else rng.randint(1, size) for _ in range(rng.randint(0, 200))]
        plan = best_fit.best_fit_patterns(dict(Counter(lengths)), size)
        rooms, placed = Counter(), Counter()
        for count, content in plan:
            rooms[size - sum(n * k for n, k in content)] += count
            for n, k in content:
                placed[n] += k * count
        assert rooms == naive_best_fit(lengths, size) and placed == Counter(lengths)


def test_capacity_tree_finds_the_tightest():
    rng, tree, is_open = random.Random(6), best_fit.CapacityTree(37), set()
    for _ in range(3000):
        room = rng.randint(0, 37)
        (is_open.add if rng.random() < 0.5 else is_open.discard)(room)
        tree.mark(room, room in is_open)
        need = rng.randint(0, 37)
        assert tree.tightest(need) == min((r for r in is_open if r >= need), default=None)


def test_best_fit_documents(documents):
    rows = best_fit.best_fit_documents(documents).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, lengths = Counter(), []
    for r in documents.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert Counter(1024 - sum(n for _, n in p) for p in sequences.values()) == naive_best_fit(lengths, 1024)
    assert best_fit.best_fit_documents(documents.limit(0)).count() == 0 and dict(best_fit.best_fit_documents(documents.limit(0)).dtypes)["piece"] == "int"


def test_equal_rows_spread_over_ranges(spark, tmp_path):
    """A third of all pieces without a key and of one length: no range takes much more than its share."""
    at = str(tmp_path / "pieces")
    spark.range(40_000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "0L as start", "100L as length").write.parquet(at)
    from loomgraph.llm.common import in_ranges

    sizes = [r[1] for r in in_ranges(spark.read.parquet(at), [F.col("length"), F.col("doc_id"), F.col("start")], "ranges").groupBy("_pid").agg(F.count(F.lit(1))).collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 4
    packed = packing.pack_pieces(spark.read.parquet(at))
    assert packed.select("sequence_id", "offset").distinct().count() == 40_000 and packed.agg(F.countDistinct("sequence_id")).first()[0] == 2000


TURNS = "conv_id long, turn long, role string, text string, kind int, gone string, digest string"


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        hit, own = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20, out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit:
            own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def repaired(rows):
    """Every repair of a conversation by strings, layer by layer: gaps, faults, illegal, cost, audit, hash."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def closed(ways):
        for _ in range(4):
            for at, (cost, audit, said) in list(ways.items()):
                for c, name in names.items():
                    if (at, c) in goes:
                        ways[goes[at, c]] = min(ways.get(goes[at, c], (1 << 60,)), (cost + 2, audit + "I", [*said, f"{name}:"]))
        return ways

    ways = closed({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        then = {}
        for at, (cost, audit, said) in ways.items():
            options = [(at, (cost + 3, audit + "D", said))]
            if fault in (None, "truncated"):
                late = fault is not None
                options += [(goes[at, c], (cost + price + late, audit + e, [*said, f"{name}:{text}"])) for e, price, c, name in [("K", 0, role[:1], role), *(("R", 2, c, name) for c, name in names.items())] if (at, c) in goes]
            for to, way in options:
                then[to] = min(then.get(to, (1 << 60,)), way)
        ways = closed(then)
    cost, audit, said = min(ways[at] for at in ("", "a") if at in ways)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(7)
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "ü"]
    for conv in range(100_000, 100_600):
        for _ in range(rng.randint(1, 9)):
            rows.append((conv if conv % 50 else None, rng.choice([None, *range(6)]) if conv % 3 else rng.randint(0, 4), rng.choice(roles[:5] if conv % 2 else roles), rng.choice(["a.", "b.", "c!", "no end", " ", "", None, "d?  \n", "漢字。"])))
    rows += [(999, t, "user", f"x{t}.") for t in range(2000)] + [(998, 5, "user", "again.")] * 500 + [(997, 1, "user", "long " * 100_000 + ".")]
    return rows


def test_repair_equals_brute_force(spark, turns):
    df = spark.createDataFrame([(*r, 1, "g", "d") for r in turns], TURNS)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_damage(df).collect()}
    want = {conv: repaired(rows) for conv, rows in damage(turns).items()}
    assert got == want
    said = defaultdict(list)
    for r in conversation_repair.repaired_turns(conversation_repair.damaged(df), gone="gone").orderBy("conv_id", "place").collect():
        assert r.place == len(said[r.conv_id])
        said[r.conv_id].append(f"{r.role}:{r.text}")
    assert {conv: hashlib.sha256("\n".join(said[conv]).encode()).hexdigest() for conv in want} == {conv: w[-1] for conv, w in want.items()}


def test_repair_of_odd_tables(spark):
    df = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair_damage(df).count() == 0 and conversation_repair.repaired_turns(df).count() == 0
    only = spark.createDataFrame([(1, None, None, None)], "conv_id long, turn long, role string, text string")
    row = conversation_repair.repair_conversations(only).first()
    assert tuple(row) == (1, 0, 1, 0, 0, 0, 3, "D", hashlib.sha256(b"").hexdigest())


def test_quality_rules_of_odd_rows(spark):
    """Null keys, repeated rows, a text of over a megabyte, names that clash with the counts, no rows."""
    from loomgraph.llm import quality_rules

    plain = "these ten words are all different so that nothing repeats"
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, plain, "a", 1), (None, plain, "a", 1), (3, None, "b", 2), (4, "", None, None), (5, long, "c", 3), (5, plain + "\n" + plain, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long")
    got = sorted((tuple(r) for r in quality_rules.judge_documents(docs).select("doc_id", "n_words", "n_dup_lines", "base_failed", "kept").collect()), key=repr)
    assert got == sorted([(None, 10, 0, False, True)] * 2 + [(3, 0, 0, True, False), (4, 0, 0, True, False), (5, 200_000, 0, False, True), (5, 20, 1, True, False)], key=repr)
    out = quality_rules.clean_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[1], rows[4]], key=repr)
    assert quality_rules.judge_documents(docs.limit(0)).count() == quality_rules.clean_documents(docs.limit(0)).count() == 0
