"""HTML extraction over pages of many templates whose article text is known."""

import time

import numpy as np
import pytest

from framewright.llm import html_extract

BODY = "Words of an article that go on for a while, long enough to be text. " * 4
ARTICLE = f"<article><p>{BODY}</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout with-sidebar">{ARTICLE}</div>',
        f'<div class="entry share-enabled">{ARTICLE}</div>',
        f'<div style="overflow: hidden">{ARTICLE}</div>',
        f'<form id="aspnetForm">{ARTICLE}</form>',
        f'<section class="social-policy">{ARTICLE}</section>',
        f"<p class=it's>{BODY}</p>",
        f'<div data-note="is hidden now">{ARTICLE}</div>',
        f"<main><div>home | login</div>{ARTICLE}</main>",
        f"<ul><li><a href=a>home</a></li><li><a href=b>news</a></li><li><a href=c>more</a></li></ul><div><p>{BODY}</p></div>",
        f"<ul><li>Home</li><li>News</li><li>Log in</li><li>Contact</li></ul><div><p>{BODY}</p></div>",
        f"<article><p>{BODY}</p><ul>{'<li><a href=x>a related story of ours</a></li>' * 5}</ul></article>",
        f"<div class='sidebar'><p>{BODY}</p></div><div class=x><a href=y>short</a></div>",
        f"<div class=ad>buy<div class=inner>more</div></div><p>{BODY}</p><div hidden>{BODY}{BODY}{BODY}</div>",
        f"<div><p>{BODY}</p></div><article><a href=z>A teaser of another story</a></article>",
    ],
)
def test_wrappers_names_and_lists(page):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == BODY.strip()


@pytest.mark.parametrize("tag", ["article", "main"])
def test_an_article_has_its_own_header(tag):
    page = f"<body><header><p>site</p></header><{tag}><header class='page-header'><h1>Title</h1></header><p>{BODY}</p></{tag}></body>"
    assert html_extract.main_text(page) == f"Title\n\n{BODY.strip()}"


@pytest.mark.parametrize(
    ("name", "noise"),
    [("ad", True), ("ad-slot", True), ("google-ads", True), ("siteFooter", True), ("site-footer", True), ("comment-list", True), ("main-nav", True), ("related-posts", True), ("widget_area", True)]
    + [(x, False) for x in ("with-sidebar", "no-sidebar", "has-banner", "social-policy", "share-enabled", "content", "shadow", "menuet", "loading", "header-text")],
)
def test_names_are_matched_whole(name, noise):
    assert html_extract.is_noise_name(name) == noise


def made_page(draw, kind):
    """A page and its article blocks; article words begin with w, all others with q."""

    def words(letter, n):
        return " ".join(f"{letter}{k}" for k in draw.integers(0, 900, n)) + "."

    blocks = [words("w", int(draw.integers(4, 9)))] + [words("w", int(draw.integers(25, 120))) for _ in range(int(draw.integers(2, 9)))]
    if draw.random() < 0.5:
        blocks.insert(2, words("w", int(draw.integers(1, 4))))
    menu = "".join(f"<li><a href=/{k}>{words('q', 1)}</a></li>" for k in range(int(draw.integers(4, 12))))
    paragraphs = [f"<h1>{blocks[0]}</h1>", *(f"<p>{x}</p>" for x in blocks[1:])]
    inner = [f"<div class='{draw.choice(['ad', 'ad-slot', 'promo', 'share-buttons', 'newsletter-signup'])}'>{words('q', 12)}</div>", f"<aside>{words('q', 20)}</aside>", f"<form><label>{words('q', 5)}</label></form>", f"<script>var a='<p>{words('q', 9)}</p>'</script>", f"<!-- {words('q', 3)} -->"]
    paragraphs.insert(2, str(draw.choice(inner)))
    body = "".join(paragraphs)
    head = f"<header><div>{words('q', 6)}</div><nav><ul>{menu}</ul></nav></header>"
    foot = f"<section id=comments><p>{words('q', 40)}</p><p>{words('q', 30)}</p></section><footer>&copy; {words('q', 10)}</footer>"
    side = f"<div class='sidebar'><h3>{words('q', 2)}</h3><ul>{menu}</ul><p>{words('q', 25)}</p></div>"
    wrapped = {
        "article": f"<article class='post social-enabled'>{body}</article>",
        "main": f"<main><ul>{menu}</ul><section>{body}</section></main>" if draw.random() < 0.5 else f"<main>{body}</main>",
        "divs": f"<div class='content with-sidebar'><div class=text>{body}</div></div>",
        "form": f"<form id=aspnetForm><div class='page'>{body}</div></form>",
        "table": f"<table><tr><td><ul>{menu}</ul></td></tr><tr><td>{body}</td></tr></table>",
        "list menu": f"<ul>{menu}</ul><div>{body}</div><ul>{menu}</ul>",
    }[kind]
    order = [head, wrapped, side, foot] if draw.random() < 0.5 else [head, side, wrapped, foot]
    return f"<!DOCTYPE html><html><head><title>{words('q', 4)}</title></head><body>{''.join(order)}</body></html>", blocks


LINK = "<a href=x>the full report of the committee</a>"


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f'<a name="top"><p>{BODY}</p>', [BODY]),
        (f"<a href=x>home<p>{BODY}</p>", [BODY]),
        (f"<div><h1>Cake</h1><p>{BODY}</p><ul><li>Flour</li><li>Sugar</li></ul></div>", ["Cake", BODY, "Flour", "Sugar"]),
        (f"<div><h1>Cake</h1><ul><li>Flour</li><li>Sugar</li></ul><p>{BODY}</p></div>", ["Cake", "Flour", "Sugar", BODY]),
        ("<dl>" + "".join(f"<dt>word {k}</dt><dd>what it says</dd>" for k in range(8)) + "</dl>", [x for k in range(8) for x in (f"word {k}", "what it says")]),
        (f"<article><p>{BODY}</p><p>See {LINK}</p></article>", [BODY, "See the full report of the committee"]),
        (f"<article><p>{BODY}</p>" + f"<p>{LINK}</p>" * 4 + f"<p>{BODY}</p></article>", [BODY, *["the full report of the committee"] * 4, BODY]),
        (f"<div><p>{BODY}</p><p>See {LINK}</p></div>", [BODY, "See the full report of the committee"]),
        (f'<article><div class="widget"><p>{BODY}</p></div><p>The end.</p></article>', [BODY, "The end."]),
        (f'<article><p>{BODY}</p><div class="widget"><p>Read our letter</p></div></article>', [BODY]),
        (f'<div class="post comments"><p>{BODY}</p><p>{BODY}</p></div><div><p>{BODY * 2}</p></div>', [BODY, BODY, BODY * 2]),
        (f'<article><p>{BODY}</p></article><article class="comment"><p>{BODY}</p></article><article hidden><p>{BODY}</p></article>', [BODY]),
        (f'<article><p>{BODY}</p><section class="comments"><p>{BODY * 5}</p></section></article>', [BODY]),
        (f"<div><p>{BODY}</p><table><tr><td>Name<td>12<tr><td>Size<td>7</table><p>The end.</p></div>", [BODY, "Name", "12", "Size", "7", "The end."]),
        (f"<div><p>{BODY}</p></div><div><ul><li>Home</li><li>News</li></ul></div>", [BODY]),
        ("<ul><li>one</li><li>two</li></ul>", ["one", "two"]),
        ("<nav><a href=x>home</a></nav><a href=y>more</a>", []),
    ],
)
def test_nothing_of_the_article_is_lost(page, blocks):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(x.strip() for x in blocks)


@pytest.mark.parametrize("wrap", ["<main><div>{}</div>{}</main>", "<div>{}</div>{}"])
def test_cards_beside_the_body(wrap):
    """Articles that hold less than half of the text don't cut off the rest."""
    card = "<article>Another story of ours and what it is all about, told in a line.</article>"
    assert BODY.strip() in html_extract.main_text(wrap.format(f"<p>{BODY}</p>", card * 2))


def slow_between(sizes, thresholds):
    """Surge and dive, read line by line from the definition."""
    n, kept, k = len(sizes), [], 0
    window = lambda i: sum(sizes[i : i + html_extract.WINDOW])
    while k < n:
        if sizes[k] and window(k) > thresholds[k]:
            end = next((j for j in range(k, n) if not window(j)), n)
            kept += range(k, max(j for j in range(k, end) if sizes[j]) + 1)
            k = end
        k += 1
    return kept


def test_surge_and_dive():
    draw = np.random.default_rng(0)
    for _ in range(3000):
        n = int(draw.integers(0, 30))
        sizes = [int(x) for x in draw.integers(1, 90, n) * (draw.random(n) < draw.choice([0.2, 0.5, 0.9]))]
        thresholds = [int(x) for x in draw.choice([0, 80], n)]
        assert html_extract.between(sizes, thresholds) == slow_between(sizes, thresholds)


def made_other(draw, kind):
    """Pages as above, of ten templates whose article is not in article, main or paragraphs alone."""

    def words(letter, low, high):
        return " ".join(f"{letter}{k}" for k in draw.integers(0, 900, int(draw.integers(low, high)))) + "."

    def menu(item="<li><a href=/{0}>q{0} q{0}</a></li>"):
        return "".join(item.format(int(k)) for k in draw.integers(0, 900, int(draw.integers(4, 10))))

    title, body = words("w", 3, 7), [words("w", 25, 90) for _ in range(int(draw.integers(3, 8)))]
    short = [f"w{k}" for k in draw.integers(0, 900, int(draw.integers(3, 12)))]
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    head, foot = f"<div id=header><a href=/>q1 q2</a><ul>{menu()}</ul></div>", f"<div class=footer>q3 {words('q', 4, 12)}</div>"
    if kind == "cards":
        cards = "".join(f"<article class=card><a href=/{k}><h3>q{k}</h3><p>{words('q', 5, 9)}</p></a></article>" for k in range(4))
        return f"{head}<main><div><h1>{title}</h1>{paragraphs}</div><section>{cards}</section></main>{foot}", [title, *body]
    if kind == "recipe":
        return f"{head}<div><h1>{title}</h1><ul>{''.join(f'<li>{x}</li>' for x in short)}</ul>{paragraphs}</div>{foot}", [title, *short, *body]
    if kind == "glossary":
        terms = [(f"w{k}", words("w", 3, 9)) for k in range(12)]
        return f"{head}<div><h1>{title}</h1><dl>{''.join(f'<dt>{a}</dt><dd>{b}</dd>' for a, b in terms)}</dl></div>{foot}", [title, *(x for pair in terms for x in pair)]
    if kind == "old anchors":
        return f"<a name=top>{head}<a name=text><h1>{title}</h1>" + "".join(f"<a name=p{k}><p>{x}" for k, x in enumerate(body)) + f"<hr>{foot}", [title, *body]
    if kind == "data table":
        cells = "".join(f"<tr><td>{x}</td><td>w{k}</td></tr>" for k, x in enumerate(short))
        return f"{head}<div><h1>{title}</h1><p>{body[0]}</p><table>{cells}</table>{paragraphs}</div>{foot}", [title, body[0], *(y for k, x in enumerate(short) for y in (x, f"w{k}")), *body]
    if kind == "breaks":
        return f"{head}<div><h1>{title}</h1><div>{'<br>'.join(body)}</div></div>{foot}", [title, " ".join(body)]
    if kind == "columns":
        return f"<table><tr><td><ul>{menu()}</ul><td><h1>{title}</h1>{paragraphs}<td><ul>{menu()}</ul></table>{foot}", [title, *body]
    if kind == "links in text":
        linked = "".join(f"<p>{x} <a href=/x>w1 w2 w3</a></p>" if k % 2 else f"<p><a href=/y>{x}</a> w4</p>" for k, x in enumerate(body))
        return f"{head}<article><h1>{title}</h1>{linked}</article>{foot}", [title, *(f"{x} w1 w2 w3" if k % 2 else f"{x} w4" for k, x in enumerate(body))]
    if kind == "quotes":
        return f"{head}<div><h1>{title}</h1>" + "".join(f"<blockquote>{x}</blockquote><h2>w7</h2>" for x in body) + f"<p>{body[0]}</p></div>{foot}", [title, *(y for x in body for y in (x, "w7")), body[0]]
    remarks = "".join(f"<div class='comment' id=c{k}><p>{words('q', 10, 60)}</p></div>" for k in range(5))
    return f"{head}<article class=post><h1>{title}</h1><div class='entry-content widget'>{paragraphs}</div><section id=comments>{remarks}</section></article>{foot}", [title, *body]


OTHERS = ["cards", "recipe", "glossary", "old anchors", "data table", "breaks", "columns", "links in text", "quotes", "remarks"]


@pytest.mark.parametrize("kind", OTHERS)
def test_ten_templates_more(kind):
    draw = np.random.default_rng(OTHERS.index(kind) + 100)
    pages = [made_other(draw, kind) for _ in range(60)]
    done = [(html_extract.main_text(f"<html><body>{x}</body></html>"), b) for x, b in pages]
    precision, recall = scores(done)
    assert precision >= 0.98 and recall >= 0.98
    if kind not in ("old anchors", "breaks"):
        assert sum(x == "\n\n".join(b) for x, b in done) >= 58


KINDS = ["article", "main", "divs", "form", "table", "list menu"]


def scores(extracted):
    """Precision and recall of words over pages, as (text, blocks)."""
    found = [x.split() for x, _ in extracted]
    right = sum(w.startswith("w") for x in found for w in x)
    want = sum(len(" ".join(b).split()) for _, b in extracted)
    return right / max(1, sum(map(len, found))), right / want


@pytest.mark.parametrize("kind", KINDS)
def test_precision_and_recall(kind):
    draw = np.random.default_rng(KINDS.index(kind))
    pages = [made_page(draw, kind) for _ in range(60)]
    done = [(html_extract.main_text(x), b) for x, b in pages]
    precision, recall = scores(done)
    assert precision >= 0.98 and recall >= 0.98
    if kind == "article":
        assert all(x == "\n\n".join(b) for x, b in done)


def test_the_windows_decide(monkeypatch):
    """Without surge and dive, every line with a size stays, and pages without an article get worse."""
    draw = np.random.default_rng(9)
    pages = []
    for _ in range(60):
        page, blocks = made_page(draw, "divs")
        junk = "".join(f"<div>q{k} q{k}</div>" for k in draw.integers(0, 900, 3)) + "<hr>" + "".join(f"<div><a href=/>q{k}</a></div>" for k in range(4))
        pages.append((page.replace("<body>", "<body>" + junk), blocks))
    own = [(html_extract.main_text(x), b) for x, b in pages]
    monkeypatch.setattr(html_extract, "between", lambda sizes, threshold: [k for k, x in enumerate(sizes) if x])
    without = [(html_extract.main_text(x), b) for x, b in pages]
    assert own != without and scores(own)[0] > scores(without)[0] and scores(own)[1] >= 0.98


def test_long_and_deep_pages_take_linear_time():
    start = time.process_time()
    for page in ("<div class=ad>" * 50_000 + "x", "<p>a" * 100_000, "<a href='" * 20_000, "<div class=" * 50_000, "<" * 100_000, "<!--" * 50_000, "<li class=ad><ul>" * 20_000):
        html_extract.main_text(page)
    assert time.process_time() - start < 30
