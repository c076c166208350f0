"""URL filters: a bit-parallel wildcard automaton simulates all glob rules at once over each canonical URL.

Rules are globs (`*`: any run of bytes, `?`: one byte). Their literal positions are laid end to end in one bit vector of
as many 64-bit words as needed; for each byte there is a mask of the positions that accept it. One Shift-And step per
byte advances all rules together: D = (((D << 1) | starts) & accepts[byte]) | (D & loops), where loops are the positions
behind which a `*` stands. The step runs on a whole batch of URLs with numpy; the URLs that are still unread form a
prefix of the batch, which is ordered by length. State is words x batch, whatever the URL's length.

Canonical URL: a dot, the host with A-Z lower-cased, a zero byte, the path. Host and path follow the contract: the host
is what follows the first `://` up to `/`, `?`, `#` or the end, the path what follows up to `?`, `#` or the end; a null
URL or one without `://` has both empty. Zero bytes of the URL are read as spaces, so a glob's separator is unambiguous.

Verdict: the longest site rule (host suffix on a label border, path prefix) that fits decides; without one, the URL is
blocked if a junk glob fits and allowed otherwise. Defined cases: null and empty URLs, URLs of any length (a step per byte of the longest in a batch: seconds a megabyte), rows without a key, repeated rows (one row
out per row in) and empty tables; columns other than those named pass through untouched in `judge_urls`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


@dataclass(frozen=True)
class SiteRule:
    """Applies to a host and all its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> bytes:
        return b"*." + self.host.encode() + b"\0" + self.path.encode() + b"*"


#: The contract's rules, as fixed values.
SITE_RULES = (
    SiteRule("block", "com", "/en/"),
    SiteRule("allow", "example.com", "/en/7"),
    SiteRule("allow", "net", "/de/"),
    SiteRule("block", "example.net", "/de/8"),
    SiteRule("block", "org", "/es/"),
)

#: Globs over canonical URLs (dot, host, zero byte, path) of sites that no rule decides.
JUNK_GLOBS = (
    b"*spam-*\0*", b"*.cheap-*\0*", b"*pills*\0*", b"*casino*\0*", b"*.viagra*\0*", b"*.porn*\0*", b"*.xxx\0*", b"*.ads.*\0*",
    b"*.adserver.*\0*", b"*.doubleclick.*\0*", b"*\0/wp-login.php*", b"*\0*.exe", b"*\0*.apk",
)


class GlobAutomaton:
    """All globs in one multiword Shift-And mask."""

    def __init__(self, globs: list[bytes]):
        cells: list[tuple[int, int | None]] = []  # (rule, byte or None for any)
        starts_once, starts_always, loops, ends, sticky = set(), set(), set(), {}, set()
        self.matches_empty = [set(g) <= {0x2A} for g in globs]
        for r, glob in enumerate(globs):
            first, star = True, False
            for c in glob:
                if c == 0x2A:
                    star = True
                    if not first:
                        loops.add(len(cells) - 1)
                    continue
                if first:
                    (starts_always if star else starts_once).add(len(cells))
                cells.append((r, None if c == 0x3F else c))
                first, star = False, False
            if not first:
                ends[r] = len(cells) - 1
                if star:
                    sticky.add(r)
        self.words = max(1, -(-len(cells) // 64))
        self.accepts = np.zeros((256, self.words), np.uint64)
        for i, (_, c) in enumerate(cells):
            self.accepts[slice(None) if c is None else c, i // 64] |= np.uint64(1 << (i % 64))
        mask = lambda at: np.array([sum(1 << (i % 64) for i in at if i // 64 == w) for w in range(self.words)], np.uint64)
        first_cells = starts_once | starts_always
        #: A bit shifted into a rule's first position comes from the rule before it.
        self.inside = ~mask(first_cells)
        self.once, self.always, self.loops = mask(first_cells), mask(starts_always), mask(loops)
        self.ends = [ends.get(r) for r in range(len(globs))]

    def run(self, urls: list[bytes]) -> np.ndarray:
        """Boolean matrix: URLs x globs."""
        n = len(urls)
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        at = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        d = np.zeros((n, self.words), np.uint64)
        alive, one, top = n, np.uint64(1), np.uint64(63)
        for i in range(int(lengths[0]) if n else 0):
            while lengths[alive - 1] <= i:
                alive -= 1
            now = d[:alive]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            shifted &= self.inside
            shifted |= self.always if i else self.once
            d[:alive] = (shifted & self.accepts[flat[at[:alive] + i]]) | (now & self.loops)
        out = np.zeros((n, len(self.ends)), bool)
        for r, end in enumerate(self.ends):
            hit = (d[:, end // 64] >> np.uint64(end % 64)) & one if end is not None else np.full(n, self.matches_empty[r])
            out[order, r] = hit.astype(bool)
        return out


def _verdicts(rules: tuple[SiteRule, ...], junk: tuple[bytes, ...]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([r.glob for r in rules] + list(junk))
        longest = sorted(range(len(rules)), key=lambda r: -len(rules[r].name))
        for batch in batches:
            urls = [u or b"" for u in batch.column(batch.num_columns - 1).to_pylist()]
            hits = automaton.run(urls)
            rule, verdict = [], []
            for row in range(len(urls)):
                won = next((r for r in longest if hits[row, r]), None)
                rule.append(None if won is None else rules[won].name)
                verdict.append(rules[won].verdict if won is not None else "block" if hits[row, len(rules) :].any() else "allow")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names[:-1], "rule", "verdict"]
            )

    return judge


def judge_urls(
    df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[SiteRule, ...] = SITE_RULES, junk: tuple[bytes, ...] = JUNK_GLOBS
) -> DataFrame:
    """key, host, path, rule (the deciding rule's name or null), verdict; one row per row of df. Only key and url are read."""
    bounded_batches(df.sparkSession)
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^([^?#]*)", 1)
    parts = df.select(F.col(key), rest.alias("_rest")).select(key, "_rest", lower.alias("_host")).select(key, F.col("_host").alias("host"), path.alias("path"))
    clean = lambda c: F.regexp_replace(F.col(c), "\\x00", " ")
    read = parts.withColumn("_url", F.concat(F.lit("."), clean("host"), F.lit("\0"), clean("path")).cast("binary"))
    schema = f"`{key}` {dict(df.dtypes)[key]}, host string, path string, rule string, verdict string"
    return read.mapInArrow(_verdicts(rules, junk), schema)
