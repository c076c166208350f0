"""The five stages of the pipeline in plain Python, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomgraph.llm import quality_rules, secret_scan


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _clean(text):
    words = _words(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    if len(words) < 10 or 100 * len(again) > 20 * len(words):
        return None
    seen, kept, lost = set(), [], 0
    for line in text.split("\n"):
        own = line.encode().split()
        if own and (line in seen or quality_rules.line_fails(line.encode(), own, quality_rules.LineRules())):
            lost += len(own)
        else:
            kept.append(line)
        seen.add(line)
    return None if 2 * lost > len(words) else "\n".join(kept)


def _distinct(rows):
    sets = {}
    for i, text, _ in rows:
        w = [x.lower() for x in _words(text)]
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return [r for r in rows if label[r[0]] == r[0]]


def _redacted(text):
    cut = [False] * (len(text) + 1)
    starts = set()
    for rule in secret_scan.BASE_RULES + secret_scan.MORE_RULES:
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m[rule.group]) >= rule.least:
                starts.add(m.start())
                for k in range(m.start(), m.end()):
                    cut[k] = True
    out = []
    for k, c in enumerate(text):
        if not cut[k]:
            out.append(c)
        elif k in starts and (k == 0 or not cut[k - 1]):
            out.append("[REDACTED]")
    return "".join(out)


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * rest > 3 * sizes[s] * w}
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / w for s in names}
        capped |= more


def plain_pieces(rows):
    """Counter of (doc_id, start, length, ids_crc32, doc_tokens) for rows (doc_id, text, lang, source, n_chars)."""
    docs = [(i, clean, s) for i, t, _, s, _ in rows if t is not None and (clean := _clean(t)) is not None]
    docs = [(i, _redacted(t), s) for i, t, s in _distinct(docs)]
    by = defaultdict(list)
    for i, t, s in docs:
        by[s].append((len(_words(t)), i, t))
    sizes = {s: sum(x[0] for x in own) for s, own in by.items()}
    target, mixed = _targets(sizes), []
    for s, own in by.items():
        u = int(hashlib.sha256(("mix-1:" + ("\0null" if s is None else s)).encode()).hexdigest()[:5], 16) / 2**20
        rate = target[s] / sizes[s]
        for r, (_, i, t) in enumerate(sorted(own), 1):
            mixed += [(i, t)] * int(np.floor(u + rate * r) - np.floor(u + rate * (r - 1)))
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in mixed:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            piece = ids[at : at + 2048]
            out[i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    return out
