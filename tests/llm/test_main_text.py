"""Main text: pages without an article element, what readers and adverts add, the scan against all regions."""

import random

from loomgraph.llm import html_text

P = "The river rose for three days and the old bridge held, though nobody in the village had expected it to."
THREE, WANT = f"<p>{P}</p>" * 3, "\n".join([P] * 3)
NAV = "<nav><a href='/'>Home</a> <a href='/a'>News</a></nav>"
SAID = "<p>I liked this story a great deal, thank you for it.</p><p>Me too, the bridge is lovely.</p>"
LIST = "<ul><li><a href=1>Road opens</a></li><li><a href=2>Snow in May</a></li></ul>"
WEIGHTS = html_text.fitted_weights()


def get(body):
    return html_text.main_text(f"<html><head><title>x</title></head><body>{body}</body></html>", WEIGHTS)


def test_labelled_pages_give_their_content():
    for page in html_text.LABELLED_PAGES:
        plain = page.replace("[[", "").replace("]]", "")
        inner = html_text.main_text(f"<main>{page[page.index('[[') + 2 : page.index(']]')]}</main>", WEIGHTS)
        assert inner and html_text.main_text(plain, WEIGHTS) == inner


def test_readers_comments_without_an_article():
    for part in ("<section id='reader-talk'><h2>Reader talk</h2>{}</section>", "<section id='reader-talk'><h3>What you say</h3>{}</section>", "<section><h2>2 comments</h2>{}</section>", "<h2>Leave a comment</h2>{}", "<div><h3>Comments</h3>{}</div>"):
        assert get(f"{NAV}<div><h1>Title</h1>{THREE}</div>" + part.format(SAID)) == f"Title\n{WANT}", part


def test_lists_of_other_pages_and_what_follows_them():
    want = f"Title\n{WANT}"
    for part in (f"<div><h3>More stories</h3>{LIST}</div><div>Published by Daily Ltd, 5 High Street</div>", f"<h3>More stories</h3>{LIST}<p>Published by Daily Ltd, 5 High Street</p>", f"<h3>Elsewhere</h3>{LIST}"):
        assert get(f"{NAV}<div><h1>Title</h1>{THREE}</div>{part}") == want, part


def test_names_inside_an_article():
    assert get(f"<article><h1>T</h1>{THREE}<div class='dfp-slot'>Buy paint now and save</div>{THREE}</article>") == f"T\n{WANT}\n{WANT}"
    assert get(f"<article><h1>T</h1>{THREE}<p class='related'>{P}</p>{THREE}</article>") == f"T\n{WANT}\n{P}\n{WANT}"
    assert get(f"<article><h1>T</h1>{THREE}<p class='related'>Related: <a href=1>Snow in the month of May</a></p>{THREE}</article>") == f"T\n{WANT}\n{WANT}"
    assert get(f"<article><h2>Discussion</h2>{THREE}<h2>Comments</h2>{THREE}</article>") == f"Discussion\n{WANT}\nComments\n{WANT}"


def test_headers_of_sections_and_of_sites():
    assert get(f"{NAV}<div><header><h1>Title</h1></header>{THREE}</div>") == f"Title\n{WANT}"
    assert get(f"<div><header><h1><a href=/>Daily News</a></h1></header>{NAV}<div><h1>Title</h1>{THREE}</div></div>") == f"Title\n{WANT}"
    assert get(f"<header><h1>Daily News</h1></header>{NAV}<div><h1>Title</h1>{THREE}</div>") == f"Title\n{WANT}"
    assert get(f"{NAV}<div><h1><a href='/t'>Title of it</a></h1>{THREE}</div>") == f"Title of it\n{WANT}"


def test_scan_finds_the_best_of_all_regions():
    rng = random.Random(7)
    parts = ["<p>some plain words of a text</p>", "<div><a href=1>a link</a> <a href=2>two more</a></div>", "<p>We use cookies here.</p>", "<h2>A heading</h2>", "loose words", "<br>", "<div class='ad'>buy</div>", "<p>one <a href=3>two</a> three four</p>", "<table><tr><td>5</td></tr></table>"]
    for _ in range(200):
        page = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        seen = html_text.tokens_of(page)
        scores = [WEIGHTS.get(context, -0.1) * (n if kind == "text" else 1) for kind, _, n, context, _, _ in seen]
        regions = [(sum(scores[a:b]), -a, -b) for a in range(len(seen)) for b in range(a + 1, len(seen) + 1)]
        best = max((r[0] for r in regions), default=0.0)
        got = html_text.main_text(page, WEIGHTS)
        if best <= 0:
            assert got == ""
            continue
        texts = set()
        for total, a, b in regions:  # sums may differ in their last digits
            if total > best - 1e-9:
                blocks: dict[int, str] = {}
                for _, text, _, _, _, block in seen[-a:-b]:
                    if text:
                        blocks[block] = blocks.get(block, "") + text
                texts.add("\n".join(t for t in (" ".join(v.split()) for v in blocks.values()) if t))
        assert got in texts, page


def test_null_keys_links_only_and_no_rows(spark):
    rows = [(None, None, f"<p>{P}</p>"), (None, "u", None), (2, None, ""), (3, "u", "<a href=1>only a link</a>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n_chars string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_pages(df).collect()}
    assert got == {(None, None): (P, len(P)), (None, "u"): ("", 0), (2, None): ("", 0), (3, "u"): ("", 0)}
    assert html_text.extract_pages(df.limit(0)).count() == 0
