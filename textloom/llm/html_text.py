"""Main text of web pages: flat text blocks classified by a small decision tree.

A tolerant scanner cuts a page into blocks at block-level tags and keeps, of each, its word count and link density. The
tree reads these of the block itself, of the block before and of the one after, and besides them a few marks of the
page's own structure: heading, inside an article, outside the article of a page that has one, inside a frame element
(nav, aside, footer, form, ...), and class or role tokens that name boilerplate. It is trained when the module is loaded,
on the labelled layouts below; counts and densities come first, marks split where these leave a doubt.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_or_empty

#: Elements whose content is no text of the page (fixed values from the HTML standard).
RAW = frozenset("script style noscript template textarea select option title iframe svg canvas head".split())
#: Elements that a reader takes for the page's frame.
FRAME = frozenset("nav aside footer form header dialog menu button".split())
ARTICLE = frozenset(("article", "main"))
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next one of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Class and role tokens that name boilerplate wherever they stand, and those that do so outside an article only. A token
#: counts when all its parts are such words (cookie-notice, not has-sidebar). Ids are never looked at: they name places.
STRONG_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter sidebar sidenav comment comments commentlist replies disqus "
    "breadcrumb breadcrumbs nav navbar navigation menu pagination footer masthead topbar banner complementary contentinfo".split()
)
WEAK_NAMES = frozenset("promotion notice overlay subscribe signup side related recommended recommendations share sharing social respond reply pager toolbar widget widgets disclaimer alert skip copyright login search".split())
#: Per cent of a page's words beyond which a form, or an element named as boilerplate, is its wrapper.
FORM_PERCENT, NAMED_PERCENT = 50, 90

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)""", re.S
)
_NAMED = re.compile(r"""\b(?:class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")

#: What the tree reads of a block.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "article", "elsewhere", "frame", "weak", "strong")

#: Labelled layouts, one a line: the blocks of a page in order. A block is its marks (A in an article, F in a frame
#: element, W or S under a weak or strong name, H heading), its words, a colon and its linked words if any, and + if it
#: is main text. What neighbours hold, and whether the page's article is elsewhere, follows from the line.
LAYOUTS = """
F1:1 F2:2 F1:1 F1:1 F2:2 S7 AH9+ A45+ A30+ A110+ A75+ F16
F2:2 F1:1 F1:1 8 AH12+ A52+ A21+ A4+ F12
F1:1 F1:1 F3:3 10 AH3+ A160+ F14
F1:1 F2:2 S9 AH7+ A1+ A80+ A2+ F11
2:2 1:1 3:3 2:2 H7+ 80+ 64+ 95+ 40:2+ H3+ 70+ 12+ 55+ 2:2 3:3 2:2 14
1:1 2:2 1:1 H5+ 35+ 110:9+ 25+ 30+ 90+ 4 2:2 3:3 2
3:3 3:3 90+ 18:3+ 70+ 1+ 42+ 60+ 5:5 4:4
F1:1 F3:3 AH9+ A120+ A30+ F8
F2:2 F3:3 AH1+ A95+ A2+
F3:3 A90+ A120+ F14
3:3 4:4 H5+ 110+ 90+ 2:2
1:1 3:3 H1+ 130+ 20+
F1:1 F3:3 A4+ A100+ A1+
F4:4 S40 AH9+ A120+ F20
F3:3 F5:5 S49 AH7+ A90+ 45 F9
F6:6 F4:4 AH5+ A60+ A48+ F15
1:1 4:4 H5+ 60+ 45+ 6:6 2:2
2:2 5:5 70+ 50+
4:4 80+ 5:5 90+ 31:30 60+
F1:1 F5:5 AH11+ A1+ A48+ A5+ 47 F9
F4:4 AH16+ A1+ A2+ A180+ A36+ F8
F2:2 AH6+ A1+ A1+ A2+
F3:3 AH12+ A2+ F18
F1:1 AH9+ A1+ A5+ S60 F12
2:2 H9+ 4 60+ 44:4+ 80+ 16+ 3:3 7 2:2
19+ 44+ 38+ 16+
H6+ 20+ 35:6+ 30+
4+
1+
12+
H3+ 5+
30:4+
24+ 24+ F1:1 S2 F2
24+ 26+ 2:2 5 2
45+ 30+ 3:3 F3
2:2 38+ 22+ 1:1 F1:1
1:1 2:2 1:1 24+ 24+ S5
2:2 3:3 2:2 22+ 45+ 30+ 4
1:1 1:1 28+ 30+ 1:1
2:2 1:1 1:1 H6+ 24+ 24+ S25 2:2 2:2
AH4:4+ A66+ A1:1+ A75+ A3:3+ A50+ A18:5+ A33+ A60:27+ A100+ F10
F1:1 F2:2 AH6+ A90+ A70:6+ A44+ A4:4 A5:5 A3:3 A4:4 A6:6 F10
AH5+ A2:2 A3:3 A3:3 A2:2 A85+ A60+ A9+ A47+
AH3+ A1+ A2+ A5+ A1+ A9+
AH4+ A20+ A2:1+ F4
AH3+ A40+ A1:1+ F10
F1:1 AH6+ A35+ A12:5+ A3:2+ A18+ F9
AH5+ A8+ A5+ A2+ A3:1+ 20 3
A6:2+ A40+ A5:3+
AH4+ A25+ A3:3+ F6
A3+
A1+
A250:5+
AH8+ A6+ A12+ A55+ A30:3+ A5+ A22+ A1:1+ A31+
AH6+ A90+ A70+ AS25 AS40 AS3 AS60
AH7+ A80+ AS12 A95+ AF30 A44+ AF6 AS90
AH2+ A40+ AF120 A55+ AF9:9 AF25
1:1 2:2 1:1 4:4 12:11 7:6 30:24 5:5 3 2:2 5 1:1 4
4:4 5:5 20:12 9:5 2:2 3 8:6 1:1 6:5
2:2 3 1:1 12:8 2 3:3 9:4 3:3
H2 3:3 2:2 4:4 H2 5:5 3:3 7 2:2
2:2 F12 H8+ 75+ 88+ F30 F5:5 F8:2 F60
F5 F8 F45 H6+ 120+ 80+ S45 S150 S20 F7 F150 F3:1
S12 60+ 44+ 90+ S80 S30 S50 S5
3:3 H6+ 70+ 85+ W8 W12:6 4:4 W20
2:2 W5 H4+ 90+ W140+ 60+ W6 W9 2:2
F1:1 30 AH5+ A60+ A77+ 25 60 4:4 F9
F2:2 12 70 AH6+ A120+ A88+ H3 40 90 35 F20
2 3 AH9+ A30+ A2+ 7:3 3 H2 2:2
45 AH4+ A10+ A4+ 8 20:2 110
"""


def layout_rows(layouts: str = LAYOUTS) -> list[tuple]:
    """FEATURES and label (1: main text) of every block of the layouts."""
    rows = []
    for line in layouts.split("\n"):
        page = [re.fullmatch(r"([AFHSW]*)(\d+)(?::(\d+))?(\+?)", b).groups() for b in line.split()]
        numbers = [(int(w), int(linked or 0) / int(w)) for _, w, linked, _ in page]
        has_article = any("A" in marks for marks, *_ in page)
        for i, (marks, _, _, label) in enumerate(page):
            on = ["H" in marks, "A" in marks, has_article and "A" not in marks, "F" in marks, "W" in marks, "S" in marks]
            rows.append((*_around(numbers, i), *map(int, on), int(bool(label))))
    return rows


def _around(numbers: list[tuple[int, float]], i: int) -> tuple:
    """Words and link density of block i, of the one before and of the one after."""
    before = numbers[i - 1] if i else (0, 0.0)
    after = numbers[i + 1] if i + 1 < len(numbers) else (0, 0.0)
    return (*numbers[i], *before, *after)


def grow(rows: list[tuple], depth: int = 10, counts: int = 6, worth: float = 0.7):
    """A decision tree: a label, or (feature, threshold, tree of values up to it, tree of the others).

    Splits lower the Gini impurity most; what a mark (a feature from `counts` on) gains is worth less than what a count or
    density gains. Ties go to the first feature, then the smallest threshold.
    """
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))

    def impurity(part):
        p = sum(r[-1] for r in part)
        return p * (len(part) - p) / len(part)

    best, now = None, impurity(rows)
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            gain = (now - impurity(low) - impurity(high)) * (1 if f < counts else worth)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, cut, low, high)
    if best is None or best[0] <= 1e-12:
        return int(2 * ones >= len(rows))
    return best[1], best[2], grow(best[3], depth - 1, counts, worth), grow(best[4], depth - 1, counts, worth)


TREE = grow(layout_rows())


def classify(features: tuple, tree=TREE) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _named(attributes: str) -> int:
    """2 or 1 when a class or role token names boilerplate strongly or weakly, else 0."""
    if "=" not in attributes:
        return 0
    found = 0
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = set(_PARTS.findall(token))
            if parts and parts <= STRONG_NAMES | WEAK_NAMES:
                found = max(found, 2 if parts & STRONG_NAMES else 1)
    return found


class _Scan:
    """Reads a page into blocks. Work is linear in the page: the stack of open elements keeps a count a name, so that an
    end tag without its start is passed over at once, and every element is pushed and popped once."""

    def __init__(self, page: str):
        self.page = page
        self.out: list[tuple[str, int, bool, bool, int, int]] = []  # text, frame, article, heading, words, linked words
        self.stack: list[tuple[str, int, bool]] = []  # open elements: name, innermost frame, article
        self.open: dict[str, int] = {}
        # Frames: the one around, kind, per cent of the page's words beyond which it is a wrapper, whether it holds an article.
        self.frames: list[list] = [[0, "", 100, True]]  # the first is none
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.in_link = self.heading = False
        self.no_end: set[str] = set()  # raw elements without a further end tag

    def top(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (0, False)

    def push(self, name: str, frame: int, article: bool) -> None:
        self.stack.append((name, frame, article))
        self.open[name] = self.open.get(name, 0) + 1

    def pop_to(self, name: str) -> None:
        """Close the innermost element of that name, which is open, and all in it."""
        while True:
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == name:
                return

    def framing(self, around: int, kind: str, percent: int) -> int:
        self.frames.append([around, kind, percent, False])
        return len(self.frames) - 1

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.out.append((text, *self.top(), self.heading, len(text.split()), len(html.unescape(" ".join(self.linked)).split())))
            self.parts.clear()
            self.linked.clear()

    def after_raw(self, name: str, at: int) -> int:
        """Where the content of a raw element that begins at `at` ends."""
        if name in self.no_end:
            return at
        if name == "head":
            end = re.compile(r"</head\s*>|<body\b", re.I).search(self.page, at)
            if end:
                return end.start() if end[0][1] != "/" else end.end()
        else:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(self.page, at)
            if end:
                return end.end()
            if name in ("script", "style", "textarea", "title", "iframe"):
                return len(self.page)
        self.no_end.add(name)
        return at

    def inline(self, name: str, attributes: str, closing: bool) -> None:
        """An inline element named as boilerplate, such as span class="ad", is a block of its own."""
        n = self.open.get(name, 0)
        if closing:
            if n:
                if n == 1:
                    self.flush()
                self.pop_to(name)
        elif name not in VOID and not attributes.endswith("/"):
            frame, article = self.top()
            if n:
                self.push(name, frame, article)
            elif _named(attributes) == 2:
                self.flush()
                self.push(name, self.framing(frame, "S", NAMED_PERCENT), article)

    def block(self, name: str, attributes: str, closing: bool) -> None:
        self.flush()
        self.heading = not closing and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name in VOID:
            return
        if closing:
            if self.open.get(name):
                self.pop_to(name)
            return
        if name in SELF_CLOSING and self.stack and self.stack[-1][0] in SELF_CLOSING[name]:
            self.pop_to(self.stack[-1][0])
        frame, article = self.top()
        named = 0 if name in ("html", "body") else _named(attributes)
        if name in ARTICLE:
            # The page's article is no part of what stands around it, but an article in an article, or one that is named
            # as boilerplate and stands in it (such as a comment), is.
            if not any(self.open.get(a) for a in ARTICLE) and not (named == 2 and frame):
                above, frame = frame, 0
                while above and not self.frames[above][3]:
                    self.frames[above][3] = True
                    above = self.frames[above][0]
        elif name in FRAME and name != "form":
            if name != "header" or not article or named == 2:
                frame = self.framing(frame, "F", 100)
        elif named == 2 or (named == 1 and not article):
            frame = self.framing(frame, "WS"[named - 1], NAMED_PERCENT)
        elif name == "form":
            frame = self.framing(frame, "F", FORM_PERCENT)
        self.push(name, frame, article or name in ARTICLE)
        self.in_link = False

    def run(self) -> list[tuple[str, str, bool, bool, int, int]]:
        at = 0
        while True:
            m = _TOKEN.search(self.page, at)
            piece = self.page[at : m.start()] if m else self.page[at:]
            if piece:
                self.parts.append(piece)
                if self.in_link:
                    self.linked.append(piece)
            if not m:
                break
            at = m.end()
            if m[0].startswith("<![CDATA["):
                self.parts.append(html.escape(m[0][9:].removesuffix("]]>")))
                continue
            if not m[2]:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if name in RAW:
                if not closing and not m[3].endswith("/"):
                    at = self.after_raw(name, at)
            elif name == "a":
                self.in_link = not closing
            elif name in BLOCK or name in FRAME:
                self.block(name, m[3], closing)
            else:
                self.inline(name, m[3], closing)
        self.flush()
        marks = self.marks()
        return [(text, marks[frame], *rest) for text, frame, *rest in self.out]

    def marks(self) -> list[str]:
        """The kinds of frames that each frame's blocks stand in. A frame that wraps the article or most of the page is none."""
        words = [0] * len(self.frames)
        for _, frame, _, _, n, _ in self.out:
            words[frame] += n
        for i in range(len(words) - 1, 0, -1):
            words[self.frames[i][0]] += words[i]
        total = sum(b[4] for b in self.out)
        marks = [""]
        for n, (around, kind, percent, holds) in zip(words[1:], self.frames[1:], strict=True):
            wraps = percent < 100 and (holds or 100 * n > percent * total)
            marks.append(marks[around] if wraps or kind in marks[around] else marks[around] + kind)
        return marks


def blocks(page: str) -> list[tuple[str, str, bool, bool, int, int]]:
    """(text, marks of frames: F, W, S; in an article, heading, words, linked words) of the non-empty blocks in page order."""
    return _Scan(page).run()


def features(page: str, named: bool = True) -> list[tuple[str, tuple]]:
    """Each block's text and FEATURES; `named` tells whether class and role tokens count."""
    found = blocks(page)
    numbers = [(words, linked / words) for *_, words, linked in found]
    has_article = any(b[2] and not b[1] for b in found)
    return [
        (text, (*_around(numbers, i), int(heading), int(article), int(has_article and not article), int("F" in marks), int(named and "W" in marks), int(named and "S" in marks)))
        for i, (text, marks, article, heading, _, _) in enumerate(found)
    ]


def main_text(page: str) -> str:
    """The page's main text: blocks that the tree takes, joined by one space."""
    return " ".join(text for text, x in features(page) if classify(x))


def extract_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Per row of pages: id, url, text, n_chars (code points). Null and empty html give an empty text; repeated rows are
    extracted each; an unclosed or cut-off page is read as far as it goes; an empty table gives an empty result; other
    columns are ignored. Pages are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("h"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
