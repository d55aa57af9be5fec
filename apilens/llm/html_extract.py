"""HTML extraction by tag-path ratios.

A page's blocks of text are grouped by root-to-leaf tag path (tags with their
classes). Text length and punctuation, less what stands in links, are aggregated
per path as ratios to the number of its blocks. Along the page both ratios are
smoothed over neighbouring blocks, as far as these stand in the same part of the
tree, and fused. A path's score is the mean of its blocks, or a share of the
score of the run of text that it stands in; what tags and names say (an article,
a menu) is one factor more. The blocks of all paths whose score reaches a share
of the best one are the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apilens.llm.common import map_arrow, table

# Fixed values of HTML: elements without content, with raw text, inside a line, and parts of a run of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msub msup q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre details summary address center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("html body main article section div td th table tr ul ol blockquote form aside nav header footer".split())
HOLDS = frozenset({"main", "article"})
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PUNCTUATION = re.compile(r"[.,;:!?…،؛؟।](?![^\s\"')\]»”’])|[。，、！？；：]")  # not the dots of hosts and numbers

# Tags and names that count against a path. A name counts if it is made up of such words and of plain ones alone.
LANDMARKS = frozenset("head nav footer aside header button dialog menu".split())
AGAINST = frozenset("""ad ads adsense advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies
    disqus footer gdpr masthead menu modal nav navbar navigation newsletter pager pagination paywall popup promo promoted promotion replies reply respond share sharing sidebar skip social
    sponsor sponsored sponsors subscribe subscription toolbar widget widgets""".split())
OUTSIDE = frozenset("alert consent discussion header login notice notices related search signup".split())  # not in an article, where they may be its subject
PLAIN = frozenset("""area bar block bottom box btn button buttons center col column container fixed float form global group holder icons inner item items layer left link links list main
    mobile module outer overlay page panel placeholder post posts primary region right row secondary section site slot small sticky sub text title top unit user wide wrap wrapper""".split())

LINKED = 0.2  # what a character in a link counts
MARK_CHARS = 40.0  # characters of prose to a punctuation mark, about
ENOUGH = 400.0  # a block of that score is content beyond doubt; more doesn't count
NEAR, SPREAD = 3, 1.0  # blocks on either side that smoothing takes in, and its standard deviation
APART = 0.1  # smoothing's factor for each section that stands between two blocks
RUN, DEEPER = 0.9, 0.6  # share of its run's score that a path gets at least, and the factor for each section further in
ARTICLE, BOILERPLATE = 5.0, 0.02  # factors of tags and names
SHARE = 0.5  # of the best score, from which on a path is content

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""")
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none""", re.I)
_WORDS = re.compile(r"[-_\d:]+|(?<=[a-z])(?=[A-Z])")


class Element:
    """An element that isn't part of a line: its place in the tree, its label, whether tags and names speak against it."""

    __slots__ = ("parent", "tag", "label", "against", "may", "holds", "depth", "chars", "marks", "section", "main", "factor", "path")

    def __init__(self, parent: Element | None, tag: str, label: str, against: bool, may: bool):
        self.parent, self.tag, self.label, self.against, self.may = parent, tag, label, against, may
        self.holds, self.chars, self.marks = False, 0.0, 0


class Block:
    """A run of text between the borders of elements that aren't part of a line."""

    __slots__ = ("element", "parts", "linked", "text", "chars", "marks")

    def __init__(self, element: Element):
        self.element, self.parts, self.linked = element, [], 0


def _speaks_against(name: str, inside: bool) -> bool:
    words = [w.lower() for w in _WORDS.split(name) if w]
    return any(w in AGAINST or (w in OUTSIDE and not inside) for w in words) and all(w in AGAINST or w in OUTSIDE or w in PLAIN for w in words)


def _opened(parent: Element, tag: str, attributes: str, inside: bool) -> Element:
    inside = inside or tag in HOLDS
    against, may, label = tag in LANDMARKS and not (tag == "header" and inside), tag not in LANDMARKS, tag
    if tag == "form":
        against = True
    if attributes and tag not in ("html", "body") and tag not in HEADINGS:
        names = [(k.lower(), v.strip("\"'").split()) for k, v in _NAME.findall(attributes)]
        against = against or any(_speaks_against(n, inside) for _, v in names for n in v)
        label = ".".join([tag, *sorted(re.sub(r"\d+", "", n) for k, v in names if k == "class" for n in v)])
        if _HIDDEN.search(attributes):
            against, may = True, False
    return Element(parent, tag, label, against, may)


def parsed(html: str) -> tuple[list[Element], list[Block]]:
    """The page's elements and its blocks in order; one pass, whatever is left open or nested wrongly."""
    root = Element(None, "", "", False, False)
    elements, blocks = [root], []
    stack: list[tuple[str, Element | None]] = []
    open_, inner, inside = Counter(), root, 0
    at, n, starts, no_comment_end = 0, len(html), True, False

    def text(raw: str) -> None:
        nonlocal starts
        if not raw:
            return
        raw = unescape(raw) if "&" in raw else raw
        if starts:
            if not raw.strip():
                return
            blocks.append(Block(inner))
            starts = False
        blocks[-1].parts.append(raw)
        if open_["a"]:
            blocks[-1].linked += len(raw.strip())

    def cut(k: int) -> None:
        nonlocal inner
        for tag, e in stack[k:]:
            open_[tag] -= 1
        del stack[k:]
        inner = next((e for _, e in reversed(stack) if e is not None), root)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        if html.startswith("<!--", lt):
            text(html[at:lt])
            end = -1 if no_comment_end else html.find("-->", lt + 4)
            no_comment_end = end < 0
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            text(html[at:lt])
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt)
        if not m:
            nxt = html[lt + 1 : lt + 2]
            if nxt == "/" or nxt.isalpha():  # a tag with a quote left open ends at its first bracket
                text(html[at:lt])
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text(html[at : lt + 1])
                at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag not in INLINE:
            starts = True
        if closing:
            for k in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[k][0] == tag:
                    cut(k)
                    break
                if tag in INLINE and stack[k][0] in SECTIONS:
                    break
            continue
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        ends = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if any(open_[t] for t in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    cut(k)
                    break
                if stack[k][0] in SECTIONS:
                    break
        open_[tag] += 1
        if tag in INLINE:
            stack.append((tag, None))
            continue
        inner.holds = True
        inside = open_["main"] + open_["article"] - (tag in HOLDS)
        inner = _opened(inner, tag, attributes, inside > 0)
        stack.append((tag, inner))
        elements.append(inner)
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        b.chars = max(0.0, len(b.text) - (1 - LINKED) * b.linked)
        b.marks = 0 if 2 * b.linked > len(b.text) else len(PUNCTUATION.findall(b.text))
    return elements, [b for b in blocks if b.text]


def _majority(elements: list[Element], blocks: list[Block]) -> None:
    """Takes back what a form or a name says against an element that holds most of the page's text and punctuation,
    if no text of sentences stands outside that nothing is said against."""
    for b in blocks:
        b.element.chars += b.chars
        b.element.marks += b.marks
    for e in reversed(elements):
        if e.parent is not None and e.tag not in LANDMARKS:
            e.parent.chars += e.chars
            e.parent.marks += e.marks
    chars, marks = elements[0].chars, elements[0].marks
    for e in [e for e in elements if e.against and e.may and 2 * e.chars > chars and 2 * e.marks >= marks][:8]:
        said = {e}
        for x in elements:  # parents come before their children
            if x.parent is not None and (x.against or x.parent in said):
                said.add(x)
        if sum(b.chars for b in blocks if b.marks and b.element not in said) < 80:
            e.against = False


def _placed(elements: list[Element], names: bool) -> None:
    """Each element's section, article, factor and path."""
    paths: dict[tuple[int, str, bool], int] = {}
    for e in elements:
        up = e.parent
        e.depth = up.depth + 1 if up else 0
        e.section = e if up is None or not (e.tag in FLOW and not (e.tag in ("td", "th") and e.holds)) else up.section
        against = e.against and names
        e.main = e if e.tag in HOLDS and names else up.main if up else None
        e.factor = (up.factor if up else 1.0) * (BOILERPLATE if against else 1.0) * (ARTICLE if e.main is e and not (up and up.main) else 1.0)
        e.path = paths.setdefault((up.path if up else -1, e.label, against), len(paths))


def _between(a: Element, b: Element, most: int = 3) -> int:
    """Sections to leave and to enter between two sections; ``most`` if there are so many."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent.section
        else:
            b = b.parent.section
        steps += 1
    return steps


def smoothed(values: list[float], sections: list[Element]) -> list[float]:
    """Over neighbouring blocks, by a Gaussian and by how near they stand in the tree."""
    kernel, out = [math.exp(-(k * k) / (2 * SPREAD * SPREAD)) for k in range(NEAR + 1)], []
    for i, own in enumerate(sections):
        total = weight = 0.0
        for j in range(max(0, i - NEAR), min(len(values), i + NEAR + 1)):
            w = kernel[abs(i - j)] * (1.0 if sections[j] is own else APART ** _between(own, sections[j]))
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def fused(length: float, marks: float) -> float:
    """The geometric mean of the length and of the length that the punctuation stands for."""
    return min(ENOUGH, math.sqrt(length * (1 + MARK_CHARS * marks)))


def block_scores(blocks: list[Block]) -> list[float]:
    """The fused ratios of each block: aggregated per path, smoothed along the page."""
    chars, marks, count = defaultdict(float), defaultdict(float), Counter()
    for b in blocks:
        chars[b.element.path] += b.chars
        marks[b.element.path] += b.marks
        count[b.element.path] += 1
    by_length = [chars[b.element.path] / count[b.element.path] for b in blocks]
    by_marks = [marks[b.element.path] / count[b.element.path] for b in blocks]
    for i in range(len(blocks) - 2, -1, -1):  # a heading counts as the block that it stands over
        if blocks[i].element.tag in HEADINGS:
            by_length[i], by_marks[i] = max(by_length[i], by_length[i + 1]), max(by_marks[i], by_marks[i + 1])
    sections = [b.element.section for b in blocks]
    return [fused(a, m) for a, m in zip(smoothed(by_length, sections), smoothed(by_marks, sections), strict=True)]


def chosen(blocks: list[Block]) -> list[bool]:
    """Whether each block's path is content."""
    own, scores = defaultdict(list), block_scores(blocks)
    ends: dict[Element, list[int]] = {}  # of the run of text that stands in a section itself
    runs, articles = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for i, (b, s) in enumerate(zip(blocks, scores, strict=True)):
        e = b.element
        own[e.path].append(s)
        if 2 * b.linked <= len(b.text):
            ends.setdefault(e.section, [i, i])[1] = i
        sums = [runs[e.section]]
        if e.main is not None and e.factor >= 1:
            sums.append(articles[e.main])
        for x in sums:
            x[0] += b.chars * s
            x[1] += b.chars
    mean = lambda x: x[0] / x[1] if x[1] else 0.0
    total, best = [], 0.0
    for i, b in enumerate(blocks):
        e, section, share = b.element, b.element.section, RUN
        score = sum(own[e.path]) / len(own[e.path])
        if e.main is not None:
            score = max(score, RUN * mean(articles[e.main]))
        for _ in range(3):
            first, last = ends.get(section, (1, 0))
            if first <= i <= last:
                score = max(score, share * mean(runs[section]))
            if section.parent is None:
                break
            section, share = section.parent.section, share * DEEPER
        total.append(score * e.factor)
        if e.factor >= 1:
            best = max(best, total[-1])
    return [best > 0 and s >= SHARE * best for s in total]


def main_text(html: str | None, names: bool = True) -> str:
    """The main text: the content's blocks in order, joined by a space. Without ``names`` the ratios decide alone."""
    elements, blocks = parsed(html or "")
    if names:
        _majority(elements, blocks)
    _placed(elements, names)
    return " ".join(b.text for b, keep in zip(blocks, chosen(blocks), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars; one row per input row.

    Null html is empty; a page without text has the empty text. The whole html
    is read however long it is, in one pass. Rows with null or repeated ids stay
    apart. An empty table gives an empty result; other columns aren't read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html_extract(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
