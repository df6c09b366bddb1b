"""Main text: the tree against an exhaustive search, pages against how they were made, and hostile input."""

import html
import random
import re
import time

from textloom.llm import html_text

BODY = "Some running text of an article that has a good many words in it, so many that it must be the text of the page."


def gini(rows):
    ones = sum(r[-1] for r in rows)
    return ones * (len(rows) - ones) / len(rows) if rows else 0.0


def paths(tree, rows):
    """Every inner node of a tree with the training rows that reach it."""
    if not isinstance(tree, int):
        f, cut, low, high = tree
        yield tree, rows
        yield from paths(low, [r for r in rows if r[f] <= cut])
        yield from paths(high, [r for r in rows if r[f] > cut])


def test_every_split_is_the_best_of_all_splits():
    for (f, cut, _, _), rows in paths(html_text.TREE, html_text.layout_rows()):

        def gain(g, at, rows=rows):
            worth = 1 if g < 6 else 0.7
            return worth * (gini(rows) - gini([r for r in rows if r[g] <= at]) - gini([r for r in rows if r[g] > at]))

        best = max(gain(g, (a + b) / 2) for g in range(12) for a in {r[g] for r in rows} for b in {r[g] for r in rows} if a < b)
        assert gain(f, cut) > best - 1e-9


def test_the_tree_reads_counts_and_densities_first():
    assert html_text.FEATURES[html_text.TREE[0]] == "density"
    used = {html_text.FEATURES[t[0]] for t, _ in paths(html_text.TREE, html_text.layout_rows())}
    assert {"words", "words_after", "density_before", "density_after"} <= used
    rows = html_text.layout_rows()
    assert sum(html_text.classify(r[:-1]) != r[-1] for r in rows) <= len(rows) // 100


def made_page(rng):
    """A page and the text of its article, which is known as the page is put together."""

    def some(n):
        return " ".join(rng.choice(["alpha", "beta", "gamma &amp; delta", "épsilon", "zeta&#33;", "a&nbsp;b"]) for _ in range(n))

    def block(tag, n):
        kept.append(some(n))
        start, end = ("", "") if rng.random() < 0.6 else ("<b>", "</b>")
        return f"<{tag}>{start}{kept[-1]}{end}" + (f"</{tag}>" if tag == "h1" or rng.random() < 0.7 else "")

    kept = []
    nav = "<nav><ul>" + "".join(f'<li><a href="/{i}">{some(rng.randint(1, 3))}</a></li>' for i in range(rng.randint(1, 8))) + "</ul></nav>"
    notice = f'<div class="{rng.choice(["ad", "cookie-notice", "newsletter"])}">{some(rng.randint(1, 40))}</div>' if rng.random() < 0.8 else ""
    inside = block("h1", rng.randint(1, 12)) + "".join(block("p", rng.choice([1, 2, 5, 30, 120])) for _ in range(rng.randint(1, 9)))
    after = rng.choice(["", f"<section class=comments><p>{some(60)}</p></section>", f"<aside>{some(50)}</aside>", f"<form>{some(9)}<input></form>", f"<div>{some(30)}</div>"])
    page = f"<!DOCTYPE html><html><head><title>{some(3)}</title><style>p{{}}</style></head><body>{nav}<!-- {some(2)} -->{notice}<script>var t='</p>';</script><article>{inside}</article>{after}<footer>{some(20)}</footer></body></html>"
    return page, " ".join(html.unescape(" ".join(kept)).split())


def test_pages_give_the_article_they_were_made_of(spark):
    rng = random.Random(12)
    made = [made_page(rng) for _ in range(300)]
    for page, text in made:
        assert html_text.main_text(page) == text
    rows = [(i // 2, "u", p, "clash") for i, (p, _) in enumerate(made + made[:1])] + [(None, None, made[0][0], None)]  # repeated and null ids
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = sorted(((i, u, html_text.main_text(p), len(html_text.main_text(p))) for i, u, p, _ in rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_ids_and_loose_names_inside_an_article_drop_nothing():
    page = f'<article><h2 id="related-work">Related work</h2><p id="search-methods">We search.</p><p class="copyright">C words</p><div class="share"><p>Share of voters rose.</p></div><p class="side">Side.</p><p id=comments>{BODY}</p></article>'
    assert html_text.main_text(page) == f"Related work We search. C words Share of voters rose. Side. {BODY}"
    assert html_text.main_text(f"<article><p>{BODY} <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p><object data=a.svg>Instead of it</object></article>") == f"{BODY} x+1 Instead of it"


def test_pages_without_an_article_element():
    assert html_text.main_text("<p>Hi there friends.</p>") == "Hi there friends." and html_text.main_text("only words") == "only words"
    links = "<ul>" + "".join(f"<li><a href={i}>Go {i}</a></li>" for i in range(5)) + "</ul>"
    assert html_text.main_text(f'{links}<div id="x"><h2>A heading of some words</h2><p>{BODY}</p><p>{BODY}</p></div><div class="comments"><p>{BODY} no</p></div>{links}') == f"A heading of some words {BODY} {BODY}"
    assert html_text.main_text(links) == ""


def test_broken_markup_is_read_as_far_as_it_goes():
    assert html_text.main_text(f'<article><p title="foo>One two three</p><p>{BODY}</p></article>') == f"One two three {BODY}"
    assert html_text.main_text(f"<article><p>{BODY}<!-- open") == BODY
    assert html_text.main_text(f"<article><p>{BODY}</div></span></p><p>More of it") == f"{BODY} More of it"


def test_deep_nesting_takes_linear_time():
    def took(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    for make in (
        lambda n: '<span class="ad">' + "<span>" * n + "x" + "</span>" * n, lambda n: "<div>" * n + "</p>x" * n, lambda n: '<div class="ad">' * n + "x", lambda n: "<svg>x" * n,
        lambda n: "<div><article>" * n + "x", lambda n: '<p title="a>' * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<noscript>a<svg>" * n,
    ):
        assert took(make(40_000)) < 20 * max(took(make(10_000)), 0.05)
    long = "<article>" + f"<p>{BODY}</p>" * 20_000 + "</article>"
    assert len(html_text.main_text(long).split()) == 20_000 * len(BODY.split())
    assert re.sub(r"\s", "", html_text.main_text("<article><p>" + "x" * 3_000_000)) == "x" * 3_000_000
