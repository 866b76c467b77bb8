"""Main-text extraction by line-block distribution.

Markup is stripped into lines, one per block element, and every line gets a size: the
length of its text. Some lines weigh nothing:

* lines made mostly of links. Inside an article with text, and in a container with
  paragraphs, only list items and lines with no other letters; a paragraph of such an article
  always weighs;
* short list items and table cells without a closing mark, where their container has no
  paragraph: a menu stands alone, a list of ingredients stands beside its text;
* lines of an aside: a menu, footer, side bar, header, form or advert, by tag or by a word
  of class, id or role, and of what is hidden;
* lines outside ``article``, if what is inside has at least half of the text in ``main``,
  or of the page; else lines outside ``main`` on the same condition.

The sizes of ``WINDOW`` following lines are summed. Text starts at a surge, the first
line with a size whose sum passes the threshold, and at the lines with a size right before it in its
container; it ends at the dive, where a whole window has no size. All lines in between
stay but those of asides, or outside the article. The threshold is zero inside
an article or ``main`` and in containers with paragraphs, so short paragraphs stay; where no sum passes
it, it is zero everywhere, and if that finds nothing, lists weigh like other lines.

Names deceive. An element that is an aside by its name alone is read after all

* inside an article, if the article's other text is less than a quarter of its own (for
  comments: if there is none);
* if another of its class names says that it is the text, and it has a quarter of the page's;
* where no article text is outside of asides, if it holds more than half of the page's
  text; by tag a menu, footer or side bar only if it also encloses an article. If that
  leaves no text, all that enclose an article are read.

A link is an ``a`` with ``href``. One that is not closed before the next ends where a
block begins.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by an empty line.

Defined cases: a null or empty page, or one without text, gives the empty text.
Unclosed comments, scripts and tags reach to the end of the page. Rows are
independent. An empty table gives an empty table. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by what they mean for running text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
ITEMS = frozenset("li td th".split())
#: Elements that hold paragraphs, lists and headings side by side.
CONTAINERS = frozenset("article aside blockquote body center dd details dialog div fieldset figure footer form header main menu nav section td th".split())
BESIDE = frozenset("nav footer aside form header menu dialog".split())
FIRM = frozenset("nav footer aside menu".split())
NEVER_TEXT = frozenset("button select noscript template iframe svg object canvas audio video map".split())
RAW = frozenset("script style textarea title xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Class names that say that an element is the text, and words for readers' remarks.
TEXT_NAMES = frozenset("article content entry hentry main post story text".split())
REMARKS = frozenset("comment comments disqus replies respond".split())
# Words of class, id and role that mark what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies "
    "copyright disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promoted "
    "recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
# Words that a name may have behind one of those, and words before one that deny it.
HOLDERS = frozenset("area bar block body box buttons container content form group holder inner item items links list menu panel posts row section slot unit widget widgets wrap wrapper".split())
DENIED = frozenset("with without no has have is not hide".split())
# Words that make up the names of a page's own header.
HEADER = frozenset("header site page top main global wrapper container".split())

WINDOW, THRESHOLD = 3, 80
#: Length up to which a list item without a closing mark may be one of a menu; paragraphs are longer.
SHORT_ITEM = 30

_VALUE = r"\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|={_VALUE})*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(rf"([^\s=\"'/]+)(?:\s*=({_VALUE}))?")
_LETTER, _ANCHOR = re.compile(r"&#?\w+;?|([^\W\d_])"), re.compile(r"<(/?)a(?=[\s/>])", re.IGNORECASE)
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSED = tuple(".!?…:;,\"')]”’»。！？")


def noise_word(name: str) -> str:
    """The word by which one class, id or role, taken whole, says that an element is not the article; else the empty text.

    The last word that is no mere holder decides, as in site-footer or ad-slot; so
    social-policy and share-enabled are no such names, and neither is with-sidebar.
    """
    parts = [x.lower() for x in _PART.findall(name)]
    while len(parts) > 1 and parts[-1] in HOLDERS and not (parts[-1] in NAMES and parts[-2] not in NAMES):
        parts.pop()
    return parts[-1] if parts and parts[-1] in NAMES and DENIED.isdisjoint(parts[:-1]) else ""


def is_noise_name(name: str) -> bool:
    """Whether a name says that an element is not the article."""
    return bool(noise_word(name))


def has_letter(text: str) -> bool:
    """Whether a text has a letter outside of character references."""
    return any(found[1] for found in _LETTER.finditer(text))


def attributes_of(text: str) -> dict[str, str]:
    """Attribute names in lower case, with their values without quotes."""
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        value = value.strip()
        found.setdefault(name.lower(), value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value)
    return found


FIRMLY, BY_NAME, BY_REMARK, BY_HALF, HIDDEN = range(5)


def _looks(tag: str, text: str, in_article: bool) -> int | None:
    """Why an element is not the article by its looks; None if it may be."""
    beside = FIRMLY if tag in BESIDE and not (tag == "header" and in_article) else None
    if not text or tag in ("html", "body"):
        return beside
    attributes = attributes_of(text)
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(attributes.get("style", "")):
        return HIDDEN
    if beside is not None or tag == "main":
        return beside
    classes = attributes.get("class", "").split()
    names = [*classes, *attributes.get("id", "").split(), *attributes.get("role", "").split()]
    if not in_article and tag != "article" and any("header" in x and x <= HEADER for x in (set(map(str.lower, _PART.findall(n))) for n in names)):
        return BY_NAME
    words = {noise_word(n) for n in names} - {""}
    if not words:
        return None
    if any(parts & TEXT_NAMES and parts <= TEXT_NAMES | HOLDERS for parts in ({x.lower() for x in _PART.findall(c)} for c in classes)):
        return BY_HALF
    return BY_REMARK if words & REMARKS else BY_NAME


@dataclass
class Aside:
    """An element that is not the article by its looks."""

    tag: str
    level: int  # how many elements of this tag were open with it
    lists: int
    parent: int  # its place among all asides, or -1
    why: int
    article: int  # the number of the article that it is in, or 0
    size: int = 0
    holds_article: bool = False


@dataclass
class Line:
    """text; the characters of it in links; letters: whether some are outside; kind: 2 in an article, 1 in main; tag: its block's; container, article, and the innermost aside or -1."""

    text: str
    links: int
    letters: bool
    kind: int
    tag: str
    container: int
    article: int
    aside: int

    @property
    def linked(self) -> bool:
        return 2 * self.links > len(self.text)


@dataclass
class Page:
    """Lines, and the asides they are in."""

    lines: list[Line] = field(default_factory=list)
    asides: list[Aside] = field(default_factory=list)


def parse(html: str) -> Page:
    """The lines of a page, in order, and the asides they are in."""
    page = Page()
    parts: list[str] = []
    open_asides: list[int] = []
    levels: dict[str, list[int]] = defaultdict(list)  # the open asides of each tag
    count: dict[str, int] = defaultdict(int)
    boxes: list[tuple[str, int]] = [("", 0)]  # open containers and their numbers
    boxed: dict[str, int] = defaultdict(int)
    articles: list[int] = []
    links = made_boxes = made_articles = 0
    in_link = closed_link = letters = False
    block = ""

    def end_line() -> None:
        nonlocal links, letters
        text = " ".join(unescape("".join(parts)).split())
        if text:
            place = boxes[-2] if block in ("td", "th", "dd") and boxes[-1][0] == block else boxes[-1]
            kind = 2 if count["article"] else 1 if count["main"] else 0
            page.lines.append(Line(text, links, letters, kind, block, place[1], articles[-1] if articles else 0, open_asides[-1] if open_asides else -1))
        parts.clear()
        links, letters = 0, False

    def close(tag: str) -> None:
        """One element of a tag ends, and with it the asides that it was."""
        count[tag] = max(0, count[tag] - 1)
        if tag == "article" and articles:
            articles.pop()
        if boxed[tag]:
            while True:
                inner, _ = boxes.pop()
                boxed[inner] -= 1
                if inner == tag:
                    break
        if levels[tag] and page.asides[levels[tag][-1]].level > count[tag]:
            last = levels[tag][-1]
            while open_asides:
                inner = open_asides.pop()
                levels[page.asides[inner].tag].pop()
                if inner == last:
                    break

    at, n = 0, len(html)
    while at < n:
        found = _TOKEN.search(html, at)
        text = html[at : found.start()] if found else html[at:]
        if text:
            parts.append(text)
            if in_link:
                links += len(" ".join(text.split()))
            else:
                letters = letters or has_letter(text)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(found[1]), found[3] or ""
        if not closing and (tag in RAW or tag in NEVER_TEXT):
            if tag not in ("script", "style"):
                end_line()
            at = _skip(html, tag, at)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing and "href" in attributes_of(attributes)
            after = _ANCHOR.search(html, at) if in_link else None
            closed_link = bool(after and after[1])
        if tag in BLOCKS:
            end_line()
            in_link = in_link and closed_link
            block = "" if closing else tag
        if tag in VOID:
            continue
        if closing:
            close(tag)
            if tag in ("ul", "ol") and open_asides:
                last = page.asides[open_asides[-1]]
                if last.tag == "li" and last.lists > count["ul"] + count["ol"]:
                    close("li")
            continue
        if tag in BLOCKS and count["p"]:
            close("p")
        if tag == "li" and open_asides and page.asides[open_asides[-1]].tag == "li" and page.asides[open_asides[-1]].lists == count["ul"] + count["ol"]:
            close("li")
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        count[tag] += 1
        if tag == "article":
            made_articles += 1
            articles.append(made_articles)
        if tag in CONTAINERS:
            if tag in ("td", "th") and boxes[-1][0] in ("td", "th"):  # cells are often left open
                boxed[boxes.pop()[0]] -= 1
            made_boxes += 1
            boxes.append((tag, made_boxes))
            boxed[tag] += 1
        why = _looks(tag, attributes, count["article"] + count["main"] > (tag in ("article", "main")))
        if why is not None:
            end_line()
            levels[tag].append(len(page.asides))
            own = articles[-1] if articles and tag != "article" else 0
            page.asides.append(Aside(tag, count[tag], count["ul"] + count["ol"], open_asides[-1] if open_asides else -1, why, own))
            open_asides.append(len(page.asides) - 1)
    end_line()
    for line in page.lines:
        if line.aside >= 0:
            page.asides[line.aside].size += len(line.text)
            page.asides[line.aside].holds_article |= line.kind > 0
    for aside in reversed(page.asides):  # an aside comes after the one that it is in
        if aside.parent >= 0:
            page.asides[aside.parent].size += aside.size
            page.asides[aside.parent].holds_article |= aside.holds_article
    return page


def _skip(html: str, tag: str, at: int) -> int:
    """Where an element ends whose content is no text."""
    if tag in RAW:
        done = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.IGNORECASE).search(html, at)
        return done.end() if done else len(html)
    depth = 1
    for found in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.IGNORECASE).finditer(html, at):
        depth += -1 if found[1] else 0 if found[0].endswith("/>") else 1
        if not depth:
            return found.end()
    return len(html)


def _read(page: Page) -> list[bool]:
    """For each aside, whether it is read after all; the last entry stands for no aside."""

    def shown(chosen: list[bool]) -> list[bool]:
        out: list[bool] = []
        for own, aside in zip(chosen, page.asides, strict=True):
            out.append(own and (aside.parent < 0 or out[aside.parent]))
        return [*out, True]

    if not page.asides:
        return [True]
    total = sum(len(x.text) for x in page.lines)
    whole: dict[int, int] = defaultdict(int)  # of each article
    for line in page.lines:
        whole[line.article] += len(line.text)

    def deceives(x: Aside) -> bool:
        rest = whole[x.article] - x.size
        if x.why == BY_HALF:
            return 4 * x.size >= total
        return bool(x.article) and (x.why == BY_NAME and 4 * rest < x.size or x.why == BY_REMARK and rest <= 0)

    told = shown([deceives(x) for x in page.asides])
    if any(x.kind and told[x.aside] for x in page.lines):
        return told
    large = [y or x.why != HIDDEN and 2 * x.size > total and (x.holds_article or x.tag not in FIRM) for x, y in zip(page.asides, told, strict=False)]
    read = shown(large)
    if not any(read[x.aside] for x in page.lines):
        read = shown([x.why != HIDDEN and (y or x.holds_article) for x, y in zip(page.asides, large, strict=True)])
    return read


def weighed(page: Page, lists: bool = False) -> tuple[list[int], list[bool], list[int]]:
    """For each line its size, whether it may be text at all, and the threshold; with lists, short items weigh too."""
    read = _read(page)
    alive = [read[x.aside] for x in page.lines]
    with_text = {x.container for x, live in zip(page.lines, alive, strict=True) if live and x.tag not in ITEMS and not x.linked and len(x.text) > SHORT_ITEM}

    articles = {x.article for x, live in zip(page.lines, alive, strict=True) if live and not x.linked and len(x.text) > SHORT_ITEM} - {0}

    def size(x: Line) -> int:
        beside = x.container in with_text
        if x.linked:
            stays = x.tag == "p" and x.article in articles or x.tag not in ITEMS and x.letters and (beside or x.article in articles)
            return len(x.text) if stays else 0
        menu = x.tag in ITEMS and len(x.text) <= SHORT_ITEM and not x.text.endswith(_CLOSED) and not beside and x.kind < 2
        return 0 if menu and not lists else len(x.text)

    sizes = [size(x) if live else 0 for x, live in zip(page.lines, alive, strict=True)]
    by_kind = [sum(y for x, y in zip(page.lines, sizes, strict=True) if x.kind >= k) for k in range(3)]
    prior = int(by_kind[1] > 0 and 2 * by_kind[1] >= by_kind[0])
    prior = 2 if by_kind[2] and 2 * by_kind[2] >= by_kind[prior] else prior
    alive = [live and x.kind >= prior for x, live in zip(page.lines, alive, strict=True)]
    sizes = [y if live else 0 for y, live in zip(sizes, alive, strict=True)]
    return sizes, alive, [0 if prior or x.container in with_text else THRESHOLD for x in page.lines]


def between(sizes: list[int], thresholds: list[int]) -> list[int]:
    """Places of the lines from each surge of the windows' sums to the last sized line before the dive."""
    sums = [sum(sizes[k : k + WINDOW]) for k in range(len(sizes))]
    kept, start, last = [], None, 0
    for k, total in enumerate([*sums, 0]):
        if start is None:
            if k < len(sizes) and total > thresholds[k] and sizes[k]:
                start = k
        elif total == 0:
            kept += range(start, last + 1)
            start = None
        if k < len(sizes) and sizes[k]:
            last = k
    return kept


def main_text(html: str | None) -> str:
    """The main text of a page."""
    page = parse(html or "")
    kept: list[int] = []
    for lists in (False, True):
        sizes, alive, thresholds = weighed(page, lists)
        kept = between(sizes, thresholds) or between(sizes, [0] * len(sizes))
        if kept:
            break
    chosen = set(kept)
    for k in kept:  # what stands right before a start, in its container
        while k and k - 1 not in chosen and sizes[k - 1] and page.lines[k - 1].container == page.lines[k].container:
            k -= 1
            chosen.add(k)
    return "\n\n".join(page.lines[k].text for k in sorted(chosen) if alive[k])


def _extracting(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                columns = [part.column(k) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Per page: the columns to keep, text and n_chars (its code points)."""
    source = pages.select(*keep, pages[html_col].alias("_html"))
    fields = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:-1])
    return source.mapInArrow(_extracting(list(keep)), f"{fields}, text string, n_chars long")
