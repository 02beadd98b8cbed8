"""Main text of pages: names that weigh, the layouts of the given pages, and the choice of container against brute force."""

import random
import re

import duckdb
import pytest

from oracle import SF
from sprocket.llm import html
from sprocket.llm.html import HEADING, PROSE, Page, extract, points

TEXT = "A long enough paragraph, with commas, and words to score."


@pytest.mark.parametrize("name", ["content no-sidebar", "elementor-widget-text", "side-by-side", "legal-news", "recipe-menu", "has-sidebar", "post with-comments", "sidebar-layout-main", "footer-adjacent-story"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_a_word_of_a_name_does_not_delete_the_text(name, attribute):
    assert extract(f'<body><nav>menu</nav><div {attribute}="{name}"><p>{TEXT}</p></div></body>') == TEXT
    assert extract(f'<body><article><h1>T</h1><p>{TEXT}</p><div {attribute}="{name}"><p>{TEXT}</p></div></article></body>') == f"T\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize("name", ["sidebar", "sidebar-left", "cookie-notice", "comment-list", "ad", "ad-box top", "newsletter_signup", "share-buttons", "site-footer"])
def test_whole_names_are_set_aside_beside_more_text(name):
    page = f'<body><div id="c"><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><div class="{name}"><p>Some words, of little weight, with commas.</p></div></body>'
    assert extract(page) == "\n".join([TEXT] * 3)


def test_what_holds_most_of_the_text_stays_whatever_its_name():
    assert extract(f'<body><p>Hi there.</p><div class="sidebar"><p>{TEXT}</p><p>{TEXT}</p></div></body>') == f"{TEXT}\n{TEXT}"


def test_marked_elements_of_links_or_scraps_go():
    links = "".join(f'<a href="/{i}">A headline of another page, number {i}</a> ' for i in range(4))
    assert extract(f'<article><p>{TEXT}</p><div class="more-related-stories">{links}</div><div class="story-share-line">Send this</div></article>') == TEXT


def test_pages_of_the_given_layout():
    """Their generator's layout: a menu, an advert, an article with a heading and paragraphs, and what follows it."""
    rows = duckdb.sql(f"select html from '{SF}/pages.parquet' where html like '%<article>%'").fetchall()
    for (page,) in rows:
        text = extract(page)
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        heading = html.unescape(re.sub(r"<[^>]+>", "", re.search(r"<h1>(.*?)</h1>", body, re.S)[1]))
        assert text.split("\n")[0] == " ".join(heading.split())
        advert = re.search(r'<div class="ad">(.*?)</div>', page, re.S)
        if advert and len(advert[1]) > 30:
            assert html.unescape(advert[1]) not in text
        for p in re.findall(r"<p>([^<]{60,})</p>", body):
            assert " ".join(html.unescape(p).split()) in text


def choice(page: Page) -> set[int]:
    """The kept elements by their definition, looked up anew for each element."""
    got = points(page)
    n = len(page.tag)
    ups = lambda i: [i, *ups(page.parent[i])] if i > 0 else []
    best = min((i for i in range(n) if got[i] == max(got)), default=0)
    inside = [u for u in ups(best) if page.tag[u] in ("article", "main")]
    if inside:
        return {inside[0]}
    kept = {best}
    for i in range(1, n):
        if i == best or page.parent[i] != page.parent[best] or page.parent[best] <= 0:
            continue
        own = [(len(t), k) for o, t, k in page.blocks if o == i]
        size, linked = sum(a for a, _ in own), sum(k for _, k in own)
        heading, prose = page.tag[i] in HEADING, page.tag[i] in PROSE
        if got[i] * 5 >= got[best] or (prose and size > 0 and linked * 4 < size and (heading or size >= 25)):
            kept.add(i)
    return kept


@pytest.mark.parametrize("seed", range(60))
def test_container_and_siblings_by_brute_force(seed):
    r = random.Random(seed)

    def node(depth: int) -> str:
        if depth == 0 or r.random() < 0.3:
            words = " ".join(r.choice(["word", "and,", "more", "text,", "here"]) for _ in range(r.randint(1, 30)))
            words = f'<a href="x">{words}</a>' if r.random() < 0.2 else words
            tag = r.choice(["p", "h2", "li", "div", "blockquote"])
            return f"<{tag}>{words}</{tag}>"
        tag = r.choice(["div", "section", "div", "article", "ul"])
        name = r.choice(["", "", ' class="sidebar"', ' class="story-menu"', ' id="comments"'])
        return f"<{tag}{name}>" + "".join(node(depth - 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    source = "<body>" + "".join(node(4) for _ in range(r.randint(1, 4))) + "</body>"
    page = Page(source)
    if not page.blocks or max(points(page)) <= 0:
        return
    kept = choice(page)

    def within(i: int) -> bool:
        return i in kept or (i > 0 and within(page.parent[i]))

    assert extract(source) == "\n".join(t for o, t, _ in page.blocks if within(o))
