"""Main text of web pages: the maximum-scoring contiguous run of words and tags.

A page is read once into a sequence of tags and text runs. Words score positive and tags negative; how much comes from pages
with labelled content (`LABELLED_PAGES`, a fixed small set): the log odds of being inside the content, by kind of token and
context (in, beside or without a main element; in a block of links; in a notice). One linear scan finds the contiguous region
with the greatest sum. Elements that are known to be no content (menus, forms, scripts, adverts, ...) count as a single tag, so
that an advert in the middle of an article costs the same whatever its length, and their words are left out of the region's
text. So do the parts under headings of readers' comments and of lists of other pages. A name that is a topic as often as a
role (related, legal, notice) makes a paragraph of an article noise only where half of its text or more is links.

Inside the region, block elements separate blocks. Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by a line feed, empty ones are left out. `<br>` is white space.

Defined cases: null, empty and text-free pages give an empty text, and so do pages of links only; an empty table gives no rows;
null keys and urls are kept as they are; of regions that score the same the first counts; markup
that is cut off or badly nested is read as far as it makes sense; very long pages take linear time; repeated rows give one
row each; columns besides the named ones are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*+)\s*+(?:=\s*+("[^"]*+"?|'[^']*+'?|[^\s>"']++))?""")
_WORD_START = re.compile(r"\S+")
_NAMES = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or never shown.
_RAW = frozenset("script style title textarea noscript template iframe object svg math canvas select audio video".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_NO_CONTENT = frozenset("nav footer aside form menu button dialog head label fieldset".split())
_MAIN_NAMES = frozenset("article content post entry story main maincontent articlebody postbody".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_NOISE_NAMES = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices notification alert banner popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond reply replies "
    "share sharing social related recommended recommendations pagination pager widget widgets skip copyright legal disclaimer search "
    "dfp gpt mpu adunit doubleclick taboola outbrain discussion feedback".split()
)
#: Names that together say that readers speak.
_READERS = (frozenset("reader readers visitor visitors user users guest".split()), frozenset("talk talks voices opinions thoughts says say posts reviews thread letters".split()))
#: Noise names that say what a block is about as often as what it is: they count only where links or few words agree.
_WEAK_NAMES = frozenset("related legal copyright notice notices notification alert search social sharing share skip recommended recommendations subscription promotion disclaimer discussion feedback menu navigation widget widgets".split())
#: Noise names that are titles of sections too; an id inside the content may be made of them.
_TITLE_NAMES = frozenset("search legal copyright notice notices notification alert navigation menu menus widget widgets social sharing advertising disclaimer subscription login promotion consent cookie cookies pagination related overlay".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RANKS = {f"h{i}": i for i in range(1, 7)}
#: Headings of what readers say and of lists of other pages.
_ASIDE_HEADING = re.compile(
    r"\s*(?:\d+\s+(?:comments?|responses|replies)|(?:reader|readers['’]?|user)\s+(?:comments|reviews|talk|opinions)|comments(?:\s*\(\d+\))?|(?:leave|post|add)\s+(?:a|your)\s+(?:reply|comment)|join\s+the\s+(?:conversation|discussion)"
    r"|(?:more|related|other|latest|popular|recommended|top)\s+(?:stories|articles|posts|news|reading)|you\s+(?:may|might)\s+also\s+like|most\s+(?:read|popular|viewed)|recommended\s+for\s+you|share\s+this(?:\s+\w+)?)\s*:?\s*",
    re.IGNORECASE,
)
#: Of these headings, those that no section of an article has.
_OTHERS = re.compile(r"\d|leave|post|join|more|also|most|share|reader|stories|posts", re.IGNORECASE)
_NOTICE = re.compile(r"^\s*(?:published|powered|hosted)\s+by\b|cookie|javascript|all rights reserved|©|copyright|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign up|log in|share this|advertis|sponsored", re.IGNORECASE)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)}


def _names(text: str) -> set[str]:
    """Words of class and id values; a value that negates (no-sidebar, has-menu) has none."""
    out: set[str] = set()
    for value in text.lower().split():
        words = _NAMES.findall(value)
        if words and words[0] not in ("no", "not", "has", "with", "without"):
            out.update(words)
    return out


class _Layout:
    """What the elements of a page hold, by the start of their tags.

    `around`: elements around the content, which hold a <main>, or 90 % of the text, or half of it and every <article> and <h1>.
    `share`: of the page's text, and of an element's own text in links, as fractions; `titled`: headings without a list, menu or form.
    """

    def __init__(self, page: str) -> None:
        ends: list[list[int]] = []  # start, then what was seen before it: text, linked text, mains, articles and h1, headings, lists
        stack: list[tuple[str, int]] = []
        count: Counter = Counter()
        text = linked = mains = marks = heads = lists = at = 0

        def pop() -> None:
            tag, i = stack.pop()
            count[tag] -= 1
            ends[i] += [text, linked, mains, marks, heads, lists]

        while m := _TAG.search(page, at):
            n = len(page[at : m.start()].strip())
            text, linked = text + n, linked + n * (count["a"] > 0)
            at, tag = m.end(), (m[2] or "").lower()
            if not tag or tag in _VOID:
                continue
            if tag in _RAW:
                found = re.compile(rf"</{tag}\s*+(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = found.end() if found and not m[1] else at if m[1] else len(page)
            elif not m[1]:
                stack.append((tag, len(ends)))
                count[tag] += 1
                ends.append([m.start(), text, linked, mains, marks, heads, lists])
                mains, marks, heads, lists = mains + (tag == "main"), marks + (tag in ("article", "h1")), heads + (tag in _HEADINGS), lists + (tag in ("nav", "ul", "ol", "form", "menu"))
            elif count[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        text += len(page[at:].strip())
        while stack:
            pop()
        self.around: set[int] = set()
        self._held: dict[int, tuple[float, float, bool]] = {}
        for start, t, k, n, u, h, o, t2, k2, n2, u2, h2, o2 in ends:
            if n2 > n or text and 10 * (t2 - t) >= 9 * text or 2 * (t2 - t) >= text and u2 - u == marks > 0:
                self.around.add(start)
            self._held[start] = ((t2 - t) / max(text, 1), (k2 - k) / max(t2 - t, 1), h2 > h and o2 == o)

    def share(self, start: int) -> float:
        return self._held.get(start, (0.0, 0.0, False))[0]

    def links(self, start: int) -> float:
        return self._held.get(start, (0.0, 0.0, False))[1]

    def titled(self, start: int) -> bool:
        return self._held.get(start, (0.0, 0.0, False))[2]


def _kind(tag: str, raw: str, in_main: bool, around: bool = False) -> str:
    """What an element is: noise, main or plain. Names make no noise of what stands around the content; ids of headings and, inside
    the content, of sections are made from titles."""
    if tag in _NO_CONTENT or tag == "header" and not in_main:
        return "noise"
    if tag in ("article", "main"):
        return "main"
    if tag in ("html", "body") or "=" not in raw and "hidden" not in raw:
        return "plain"
    a = _attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return "noise"
    if a.get("role", "").lower() in _ROLES:
        return "noise"
    names = _names(f"{a.get('class', '')} {a.get('id', '')}")
    noise = names & _NOISE_NAMES or not in_main and names & _READERS[0] and names & _READERS[1]
    if in_main and tag == "p":
        noise = noise and not names & _NOISE_NAMES <= _WEAK_NAMES
    elif tag in _HEADINGS:
        noise = _names(a.get("class", "")) & _NOISE_NAMES
    elif in_main and (tag == "section" or "section" in a.get("class", "").lower().split()):
        of_id = _names(a.get("id", ""))
        noise = _names(a.get("class", "")) & _NOISE_NAMES or (of_id if of_id and of_id <= _NOISE_NAMES - _TITLE_NAMES else None)
    if not around and (noise or "header" in names and not in_main and tag not in _HEADINGS):
        return "noise"
    if a.get("role", "").lower() == "main" or a.get("itemprop") == "articleBody" or names & _MAIN_NAMES and tag in ("div", "section", "td"):
        return "main"
    return "plain"


def read_page(page: str) -> Iterator[tuple[str, str, int, str, int, int]]:
    """(kind, text, words, context, start, block) of each tag and text run; text only in runs that may be content."""
    stack: list[tuple[str, str, int]] = []  # name, kind, start
    count: Counter = Counter()  # open elements by name and by kind
    at, block, end = 0, 0, len(page)
    layout: _Layout | None = None
    aside: tuple[int, int] | None = None  # elements open around a heading of an aside, and its rank
    rank = 0  # of the heading that is open

    def pop() -> None:
        tag, kind, _ = stack.pop()
        count[tag] -= 1
        count["+" + kind] -= 1

    def close(tag: str, within: frozenset[str] = frozenset()) -> None:
        if count[tag] and not (within and next((t for t, _, _ in reversed(stack) if t == tag or t in within), None) != tag):
            while stack and stack[-1][0] != tag:
                pop()
            pop()

    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not text.isspace():
            if rank and not aside and not count["+noise"] and _ASIDE_HEADING.fullmatch(html.unescape(text)):
                i = max(k for k, (t, _, _) in enumerate(stack) if t in _RANKS)
                layout = layout or _Layout(page)
                own = i > 0 and stack[i - 1][0] not in ("html", "body", "main", "article") and layout.share(stack[i - 1][2]) < 0.5
                if own or not count["+main"] and _OTHERS.search(text):
                    aside = (i, 0 if own else rank)
            if not count["+noise"] and not aside:
                text = html.unescape(text) if "&" in text else text
                n = sum(1 for _ in _WORD_START.finditer(text))
                context = "main" if count["+main"] else "body"
                context += ":notice" if n <= 40 and _NOTICE.search(text) else ":head" if rank else ":link" if count["a"] else ""
                yield "text", text, n, context, at, block
        elif text and not count["+noise"] and not aside:
            yield "text", " ", 0, "space", at, block
        if not m:
            return
        start, at = m.start(), m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            noisy = count["+noise"] or aside
            close(tag)
            rank = rank if any(count[h] for h in _RANKS) else 0
            if aside and len(stack) < aside[0]:
                aside = None
            block += tag in _BLOCKS
            if not noisy:
                yield "tag", "", 0, "block" if tag in _BLOCKS else "inline", start, block
            continue
        if tag in _BLOCKS and count["p"]:
            close("p", frozenset(("table", "article", "section", "div")))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            close(tag, frozenset(("ul", "ol", "dl", "table")))
        block += tag in _BLOCKS
        if tag in _RAW:
            found = re.compile(rf"</{tag}\s*+(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = found.end() if found else end
            if not count["+noise"] and not aside:
                yield "tag", "", 0, "raw", start, block
            continue
        if tag in _RANKS:
            rank = _RANKS[tag]
            if aside and aside[1] and rank <= aside[1] and len(stack) == aside[0]:
                aside = None
        kind = _kind(tag, m[3], bool(count["+main"]))
        if tag in ("button", "label") and count["p"] and not count["form"]:
            kind = "plain"  # a word of a sentence
        if kind == "noise" and not count["+noise"] and ("=" in m[3] or tag == "header" and len(stack) > 1):
            layout = layout or _Layout(page)
            kind = _kind(tag, m[3], bool(count["+main"]), start in layout.around)
            if tag == "header" and kind == "noise" and stack and stack[-1][0] not in ("html", "body") and layout.titled(start) and layout.links(start) < 0.5 and "=" not in m[3]:
                kind = "plain"  # the title of a section
        if tag == "p" and kind == "plain" and count["+main"] and "=" in m[3] and not count["+noise"] and _names(" ".join(_attributes(m[3]).get(k, "") for k in ("class", "id"))) & _WEAK_NAMES:
            layout = layout or _Layout(page)
            kind = "noise" if layout.links(start) >= 0.5 else kind
        if not count["+noise"] and not aside:
            yield "tag", " " if tag == "br" else "", 0, ("noise in main" if count["+main"] else "noise") if kind == "noise" else "link" if tag == "a" else "block" if tag in _BLOCKS else "inline", start, block
        if tag not in _VOID:
            stack.append((tag, kind, start))
            count[tag] += 1
            count["+" + kind] += 1


def tokens_of(page: str) -> list[tuple[str, str, int, str, int, int]]:
    """`read_page` with the contexts that need whole blocks: a block most of whose words are links is `links`, and so is a heading
    right before one. On pages with a main element, words outside it are a context of their own."""
    seen = list(read_page(page))
    words, linked, heads, order = Counter(), Counter(), set(), []
    for kind, _, n, context, _, block in seen:
        if kind == "text" and n:
            if not order or order[-1] != block:
                order.append(block)
            words[block] += n
            linked[block] += n * context.endswith(":link")
            if context.endswith(":head"):
                heads.add(block)
    links = {b for b in order if 2 * linked[b] > words[b]}
    for block, after in zip(reversed(order[:-1]), reversed(order[1:]), strict=True):
        if block in heads and after in links:
            links.add(block)
    with_main = any(kind == "text" and context.startswith("main") for kind, _, _, context, _, _ in seen)
    out = []
    for kind, text, n, context, start, block in seen:
        if kind == "tag":
            context = f"<{context}>"
        elif n:
            place, _, what = context.partition(":")
            context = (place if place == "main" or not with_main else "beside") + (":notice" if what == "notice" else ":links" if block in links else "")
        out.append((kind, text, n, context, start, block))
    return out


def _labelled(title: str, body: str) -> str:
    return f"<html><head><title>{title}</title><style>p {{ }}</style></head><body>{body}</body></html>"


_P = "<p>The river rose for three days and the old bridge held, though nobody in the village had expected it to.</p>"
_Q = "<p>Cookies were sold at the fair, the newsletter of the parish said, and <a href='/y'>every stall</a> had gone by noon.</p>"
_ITEMS = "<ul><li><a href='/1'>Old mill for sale</a></li><li><a href='/2'>Mayor opens new road</a></li><li><a href='/3'>Snow closes the pass</a></li></ul>"
#: Pages whose content stands between [[ and ]]: a fixed set, which bounds the sample that the weights are fitted on.
LABELLED_PAGES = (
    _labelled("News", f'<header><a href="/">Daily</a></header><nav><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></nav><article>[[<h1>Bridge holds</h1>{_P}{_P}<p>Read <a href="/c">the report</a>.</p>{_P}]]</article><aside>Most read</aside><div>Weather today: rain</div><footer>&copy; Daily</footer>'),
    _labelled("Blog", f'<div id="top"><a href="/">Home</a> <a href="/about">About me</a></div><div class="post">[[<h2>On bridges</h2>{_P}<blockquote>It held.</blockquote>{_P}<ul><li>stone</li><li>timber</li></ul>{_P}]]</div><div class="comments"><p>Great post, thank you!</p></div><p>Powered by a blog engine</p>'),
    _labelled("Manual", f'<div><a href="1">One</a> | <a href="2">Two</a> | <a href="3">Three</a></div><main>[[<h1>Bridge care</h1>{_P}<pre>inspect; repair;</pre>{_P}<div class="ad">Buy paint</div>{_P}]]</main><div>Last built on Monday</div>'),
    _labelled("Plain", f'<div><a href="x">Index</a> <a href="y">Next</a></div>[[<h1>A plain page</h1>{_P}{_P}{_P}]]<div>We use cookies on this site.</div><div><a href="z">Back to top</a></div>'),
    _labelled("Shop", f'<p>We use cookies. <a href="/c">More</a></p><div id="content">[[<h1>Bridge paint</h1>{_P}<table><tr><td>Red</td><td>2 kg</td></tr></table>{_P}]]</div><div><a href="/d">Delivery</a><a href="/r">Returns</a></div><p>All rights reserved.</p>'),
    _labelled("Lists", f'<div>{_ITEMS}</div><div>[[<h1>A fair in May</h1>{_Q}{_P}{_Q}]]</div><div><h3>Elsewhere</h3>{_ITEMS}</div><p>Published by the Parish, 2 Mill Lane. All rights reserved.</p>'),
    _labelled("Portal", f'<div>We use cookies and similar means to make this site better for you and to count visits.</div><div>{_ITEMS}{_ITEMS}</div><div>[[{_P}{_Q}]]</div><div><a href="/t">Terms of use</a> <a href="/p">Privacy policy</a></div><div>Copyright of the Portal, all rights reserved. Sign up for our newsletter to hear of every fair in the valley.</div>'),
    _labelled("Index", f'<p>Part 3 of the handbook</p><main>[[<h1>Mills</h1>{_P}{_ITEMS}{_P}<p>See also</p>{_ITEMS}{_Q}]]</main><p>Page built in May by the editors</p>{_ITEMS}'),
    _labelled("Paper", f'<div>Issue 12 of the weekly paper, 30 pence</div><article>[[<h1>The fair</h1>{_Q}{_P}{_P}]]</article><div>{_ITEMS}</div><div>Print edition out on Friday</div>'),
)


def fitted_weights(pages: tuple[str, ...] = LABELLED_PAGES) -> dict[str, float]:
    """Score of a word or a tag by context: smoothed log odds of being inside the labelled content.

    A tag's are scaled down, so that a paragraph of one word still counts, and never above zero: a tag is never content.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        a, b = page.index("[["), page.index("]]") - 2
        for kind, _, n, context, start, _ in tokens_of(page.replace("[[", "").replace("]]", "")):
            (inside if a <= start < b else outside)[context] += n if kind == "text" else 1
    total_in, total_out = sum(inside.values()), sum(outside.values())
    odds = {f: math.log((inside[f] + 0.5) / (total_in + 1)) - math.log((outside[f] + 0.5) / (total_out + 1)) for f in inside | outside}
    scale = {"<block>": 0.1, "<inline>": 0.05, "<link>": 0.1, "<raw>": 0.1, "<noise in main>": 0.1}
    return {f: 0.0 if f == "space" else min(w, -0.2) * scale.get(f, 1.0) if f.startswith("<") else w for f, w in odds.items()}


def main_text(page: str, weights: dict[str, float]) -> str:
    """The text of the best region, its blocks joined by line feeds."""
    seen = tokens_of(page)
    best, found, now, begin = 0.0, (0, 0), 0.0, 0
    for i, (kind, _, n, context, _, _) in enumerate(seen):
        score = weights.get(context, -0.1)
        now += score * n if kind == "text" else score
        if now > best:
            best, found = now, (begin, i + 1)
        if now <= 0:
            now, begin = 0.0, i + 1
    blocks: list[str] = []
    at = None
    for kind, text, _, _, _, block in seen[found[0] : found[1]]:
        if text:
            if block != at:
                blocks.append("")
                at = block
            blocks[-1] += text
    clean = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """key, url, text, n_chars: one row per row of df."""
    bounded_batches(df.sparkSession)
    scores = weights or fitted_weights()
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((p or b"").decode("utf-8", "replace"), scores) for p in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, url, "text", "n_chars"])

    schema = f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long"
    return df.select(key, url, F.col(body).cast("binary").alias("_html")).mapInArrow(run, schema)
