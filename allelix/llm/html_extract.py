"""HTML extraction by consensus host paths.

Every page's containers are scored by the paragraphs they hold, and each climbs to its article or main element, or to
the nearest element that adds headings and paragraphs for the most part, as long as there is one. Each page votes, with
shares of its score, for the generalised paths of these (tags with classes and ids, digits blotted out); votes are
added up per host, and every page of a host is extracted again from the elements that stand at the winning path. A page
without such an element, or without text in it, is extracted from its own best one. Menus, headers outside the article,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever they stand. A
class or id tells these by a known name, alone or next to words that don't change it, or by a word for adverts, menus or
comments that begins or ends it (google-ads, adslot, mobile-nav; not share-price, has-sidebar). What only a name, a role or a tag like form marks as one of these is kept where it is a wrapper: where it holds more of the
page's text than lies outside all of them, together with its heading, article or main element.

A page is read once from front to back, in time proportional to its length: tags as browsers delimit them (quotes count
behind an equals sign only, an unclosed tag at the end is dropped, an unclosed quote is an ordinary character), and
elements nested deeper than DEPTH become siblings.

Null or empty html gives an empty text; a null or odd url is voted on together with others of an empty host. Repeated
rows give repeated rows, ties between paths go to the path that sorts last. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import require, written

# Element names by what they mean for extraction.
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mo mn ms mrow msup msub mfrac".split())
RAW = set("script style xmp iframe noembed noframes title textarea".split())
DROPPED = set("script style noscript template head title button select option textarea input iframe object embed svg canvas audio video map legend xmp noembed noframes".split())
#: Left out unless a wrapper.
USUALLY_DROPPED = set("nav footer aside form menu dialog fieldset".split())
CONTAINERS = set("article main section div td body center blockquote form".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Elements whose classes and ids say nothing: the page itself, and what text is made of.
UNNAMED = set("html body main pre code blockquote h1 h2 h3 h4 h5 h6 table thead tbody tr td th figure".split())
NOT_TEXT = set(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification popup modal overlay newsletter"
    " subscribe subscription paywall sidebar sidebars rail aside nav navbar navigation menu menus breadcrumb breadcrumbs footer comment comments commentlist disqus respond replies reply share sharing social"
    " related recommended recommendations widget widgets toolbar pagination pager login signin signup register search alert banner masthead topbar outbrain taboola skip tagcloud tags"
    " feedback discussion discussions".split()
)
#: What may stand beside such a word in a class or id without changing what it means.
BESIDE = set(
    "left right top bottom upper lower primary secondary main site global wrapper wrap outer inner box container content area list block section region module unit slot group row col column bar panel pane holder"
    " post posts article articles entry blog reader readers user users button buttons link links item items icon icons form title heading header body js"
    " law policy message trail mobile desktop tool tools thread threads".split()
)
#: Words that mark an element where they begin or end a class or id, whatever else is in it: adverts, menus, comments.
MARKS = set("ad ads advert adverts advertisement advertising adsense adsbygoogle dfp sponsor sponsored nav navbar navigation breadcrumb breadcrumbs comment comments commentlist disqus sidebar newsletter gdpr".split())
#: With these before or behind it, such a word says what stands beside the element, or a state.
STATES = set("has have with no not without is hide show hoc open opened closed enabled disabled count free".split())
#: Two words that mark an element together only.
PAIRS = {"top bar", "bottom bar", "most read", "most popular", "more stories", "author bio", "tag list"}
_joined_ad = re.compile("(?:ad|advert)s?(?:slot|box|unit|block|container|wrapper|wrap|banner|space|zone|frame|label|holder|area|spot)s?")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Characters that a paragraph has at least where it decides how far to climb.
LEAST = 40
#: Levels of nesting beyond which elements become siblings.
DEPTH = 512

_tag = re.compile(r"""(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)?)*+)>""")
_name = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_attribute = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/>]|$)""", re.I)
_ends = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_digits = re.compile(r"\d+")
_hidden = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Element:
    tag: str
    step: str  # tag with classes and ids
    parent: int
    dropped: bool
    inside: bool  # within an article or main element
    link: bool
    doubt: int = 0  # 1, 2: dropped unless a wrapper; of 2, only one with a heading, article or main element
    score: float = 0.0


@dataclass
class Page:
    """Elements in page order, and the page's runs: (element, text), or (element, None) where a block begins or ends."""

    elements: list[Element]
    runs: list[tuple[int, str | None]] = field(default_factory=list)

    def path(self, k: int) -> str:
        """An element's generalised path."""
        steps = []
        while k > 0:
            if self.elements[k].tag not in INLINE:
                steps.append(self.elements[k].step)
            k = self.elements[k].parent
        return "".join(f">{s}" for s in reversed(steps))

    def at(self, path: str) -> set[int]:
        """The elements at a path: those at its first step, their children at the next, and so on."""
        steps, found = path.split(">")[1:], []
        level = {0: 0}
        for k, e in enumerate(self.elements[1:], 1):
            d = level.get(e.parent)
            if d is None:
                continue
            if e.tag in INLINE:
                level[k] = d
            elif d < len(steps) and e.step == steps[d]:
                level[k] = d + 1
                if d + 1 == len(steps) and not e.dropped:
                    found.append(k)
        return set(found)


def _attributes(found: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(found)} if found else {}


def _doubt(tag: str, own: dict[str, str], inside: bool) -> int:
    """Whether an element is left out unless a wrapper, and of what kind (see Element)."""
    if tag in ("html", "body"):
        return 0
    if tag == "form" or "hidden" in own or own.get("aria-hidden") == "true" or ("style" in own and _hidden.search(own["style"])):
        return 1
    if tag in USUALLY_DROPPED or (tag == "header" and not inside) or own.get("role", "").lower() in ROLES:
        return 2
    if tag in UNNAMED:
        return 0
    for k, name in enumerate(f"{own.get('class', '')} {own.get('id', '')}".split()):
        parts = [p.lower() for p in _words.findall(name)]
        known = NOT_TEXT.intersection(parts)
        if known and all(p in NOT_TEXT or p in BESIDE for p in parts):
            # An article may carry such names next to others; a comment carries them first.
            paper = known <= {"discussion"} and (tag == "section" or name == own.get("id"))  # a part of one
            if (tag != "article" or parts[0] in ("comment", "reply")) and not paper:
                return 1 if k else 2
        if parts and tag != "article" and not STATES.intersection((parts[0], parts[-1], *parts[1:2])):
            if MARKS.intersection((parts[0], parts[-1])) or " ".join(parts) in PAIRS or any(_joined_ad.fullmatch(p) for p in parts):
                return 1
        if not inside and tag != "article" and "header" in parts and all(p in ("header", "site", "top", "main", "global", "wrapper", "inner", "bar", "container") for p in parts):
            return 2
    return 0


def parsed(html: str) -> Page:
    elements = [Element("", "", -1, False, False, False)]
    page = Page(elements)
    runs = page.runs
    # Open elements; beside them the places of those that aren't inline, each with counts of inline ones open above it.
    stack, firm, above = [0], [0], [Counter()]
    open_: Counter[str] = Counter()
    at, n, strict = 0, len(html), True

    def pop_to(k: int) -> None:
        if firm[-1] >= k:
            runs.append((elements[stack[firm[bisect_left(firm, k)]]].parent, None))
        while len(stack) > k:
            gone = elements[stack.pop()].tag
            open_[gone] -= 1
            if firm[-1] == len(stack):
                firm.pop()
                above.pop()
            else:
                above[-1][gone] -= 1

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            runs.append((stack[-1], html[at:]))
            break
        following = html[begin + 1 : begin + 3]
        if following[:1] in ("!", "?") or (following[:1] == "/" and following[1:] and not following[1:].isalpha()):
            if begin > at:
                runs.append((stack[-1], html[at:begin]))
            if html.startswith("<!--", begin):
                end = min((e for e in (html.find("-->", begin + 2), html.find("--!>", begin + 4)) if e >= 0), default=n)
                at = html.find(">", end) + 1 if end < n else n
            else:
                end = html.find(">", begin)
                at = n if end < 0 else end + 1
            continue
        m = (_tag if strict else _name).match(html, begin + 1)
        if not m and strict and _name.match(html, begin + 1):
            strict = False  # no tag ends by the rules any more
            m = _name.match(html, begin + 1)
        if not m or not m[2].isascii():
            if begin >= at:
                runs.append((stack[-1], html[at : begin + 1]))
            at = begin + 1
            continue
        if begin > at:
            runs.append((stack[-1], html[at:begin]))
        if strict:
            at, found = m.end(), m[3]
        else:
            end = html.find(">", m.end())
            at, found = (n, "") if end < 0 else (end + 1, html[m.end() : end])
            if end < 0:
                break
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                if above[-1][tag] > 0:
                    k = len(stack) - 1
                    while elements[stack[k]].tag != tag:
                        k -= 1
                    pop_to(k)
            elif open_[tag] > 0:
                k = len(firm) - 1
                while elements[stack[firm[k]]].tag != tag:
                    k -= 1
                pop_to(firm[k])
            elif tag in ("p", "br"):
                runs.append((stack[-1], None))
            continue
        if tag in CLOSES_P or tag in SAME:
            ends = SAME.get(tag, ("p",))
            while elements[stack[firm[-1]]].tag in ends:
                pop_to(firm[-1])
                if tag != "tr" and tag != "tbody":
                    break
        if tag == "br" or tag == "hr":
            runs.append((stack[-1], None))
        if tag in VOID:
            continue
        up = stack[-1]
        top = elements[up]
        own = _attributes(found)
        step = tag + (f"#{_digits.sub('0', own['id'])}" if own.get("id") else "") + "".join(f".{c}" for c in sorted({_digits.sub("0", c) for c in own.get("class", "").split()}))
        inline = tag in INLINE
        dropped = top.dropped or tag in DROPPED
        beyond = len(firm) > DEPTH and not inline
        # A firm element beyond the depth stands beside the one it is written in.
        parent = elements[up].parent if beyond and elements[up].parent >= 0 else up
        elements.append(Element(tag, step.replace(">", ""), parent, dropped, top.inside or tag in ("article", "main"), top.link or tag == "a", 0 if dropped else _doubt(tag, own, top.inside)))
        if not inline:
            runs.append((len(elements) - 1, None))
        if tag in RAW:
            end = _ends[tag].search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = n if close < 0 else close + 1
            runs.append((stack[-1], None))
        elif found.endswith("/") and tag in ("svg", "path", "math"):
            continue
        else:
            open_[tag] += 1
            if inline:
                above[-1][tag] += 1
            else:
                firm.append(len(stack))
                above.append(Counter())
            stack.append(len(elements) - 1)
    _drop_doubtful(page)
    return page


def _drop_doubtful(page: Page) -> None:
    """Drops what is in doubt, except wrappers: those that hold more text than lies outside everything in doubt, and
    the page's heading, article or main element (or, for some kinds, nine tenths of a page that has none of these)."""
    elements = page.elements
    if not any(e.doubt for e in elements):
        return
    chars, marks, covered = [0] * len(elements), [0] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        covered[k] = covered[e.parent] or e.doubt > 0
    outside = every = 0
    for e, text in page.runs:
        if text is not None and not elements[e].dropped and not elements[e].link:
            size = len(text.strip())
            chars[e] += size
            outside += 0 if covered[e] else size
    for e in elements[1:]:
        every += not e.dropped and not e.doubt and e.tag in ("h1", "main", "article")
    wrapper = [False] * len(elements)
    for k in range(len(elements) - 1, 0, -1):
        e = elements[k]
        if not e.dropped and not e.doubt and e.tag in ("h1", "main", "article"):
            marks[k] += 1
        if e.doubt:
            wrapper[k] = chars[k] > outside and chars[k] >= LEAST and (marks[k] > 0 or (e.doubt == 1 and every == 0 and chars[k] >= 9 * outside))
            if not wrapper[k]:
                continue
        chars[e.parent] += chars[k]
        marks[e.parent] += marks[k]
    for k, e in enumerate(elements[1:], 1):
        e.dropped = e.dropped or elements[e.parent].dropped or (e.doubt > 0 and not wrapper[k])


def blocks(page: Page, keep: set[int] | None = None) -> Iterator[tuple[int, str, int]]:
    """(container element, text, characters of links) of every block outside what is dropped; keep: only what lies
    within these elements."""
    elements, within = page.elements, None
    if keep is not None:
        within = [False] * len(elements)
        for k, e in enumerate(elements):
            within[k] = k in keep or (e.parent >= 0 and within[e.parent])
    held: list[str] = []
    links, owner = 0, 0
    for e, text in [*page.runs, (0, None)]:
        if text is None:
            if held:
                joined = " ".join("".join(held).split())
                if joined:
                    yield owner, joined, links
                held, links = [], 0
        elif not elements[e].dropped and (within is None or within[e]):
            if not held:
                owner = e
            held.append(unescape(text) if "&" in text else text)
            links += len(text) if elements[e].link else 0


def _climbed(elements: list[Element], found: list[tuple[int, int, bool]], start: Iterable[int]) -> dict[int, int]:
    """For containers, by place, what each stands in: its outermost article, else its outermost main element, else the
    highest element on the way up to which headings and paragraphs are most of what is added. found: (element,
    characters, whether it has few links) of the page's blocks."""
    prose, all_ = [0] * len(elements), [0] * len(elements)
    for e, n, plain in found:
        all_[e] += n
        k = e
        while elements[k].tag in INLINE or elements[k].tag in ("li", "ul", "ol", "pre", "figure", "figcaption"):
            k = elements[k].parent
        if plain and (elements[k].tag in HEADINGS or (elements[k].tag == "p" and n >= LEAST)):
            prose[e] += n
    for k in range(len(elements) - 1, 0, -1):
        prose[elements[k].parent] += prose[k]
        all_[elements[k].parent] += all_[k]
    # Where twice the prose less all characters is larger than below, prose is most of what was added since.
    worth = [2 * p - n for p, n in zip(prose, all_, strict=True)]
    higher, top, outer = [0] * len(elements), list(range(len(elements))), [(0, 0)] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        article, main = outer[e.parent]
        outer[k] = (article or (k if e.tag == "article" else 0), main or (k if e.tag == "main" else 0))
        up = e.parent
        while up > 0 and not (worth[up] > worth[k] and elements[up].tag in CONTAINERS):
            # Nothing below the element that is higher than ``up`` is higher than k either.
            up = higher[up] if worth[up] <= worth[k] else elements[up].parent
        higher[k] = max(up, 0)
        if higher[k]:
            top[k] = top[higher[k]]
    return {k: outer[k][0] or outer[k][1] or top[k] for k in start}


def container_scores(page: Page) -> list[tuple[float, int]]:
    """(score, element) of what the page's scored containers stand in, each with their scores added up, best first."""
    elements = page.elements
    found: list[tuple[int, int, bool]] = []
    for e, text, links in blocks(page):
        share = max(0.0, 1 - links / len(text))
        found.append((e, len(text), share >= 0.5))
        worth = share * (1 + min(len(text) / 100, 5) + min(text.count(",") + text.count("."), 5) / 2)
        if share < 0.5:
            continue
        while elements[e].tag not in CONTAINERS and elements[e].parent > 0:
            e = elements[e].parent
        elements[e].score += worth
        up = elements[e].parent
        if up > 0:
            elements[up].score += worth / 2
    scored = [k for k, e in enumerate(elements) if e.score > 0 and not e.dropped and (e.tag in CONTAINERS or e.parent <= 0)]
    total: dict[int, float] = {}
    for k, top in _climbed(elements, found, scored).items():
        e = elements[k]
        total[top] = total.get(top, 0.0) + e.score * (2 if e.tag in ("article", "main") or e.inside else 0.6 if e.tag == "body" else 1)
    return sorted(((score, k) for k, score in total.items()), key=lambda x: (-x[0], x[1]))


def extract(html: str, path: str | None) -> tuple[str, str | None]:
    """(text, path it was taken from)."""
    page = parsed(html)
    text = _text(page, page.at(path)) if path else ""
    if not text:
        best = container_scores(page)[:1]
        path = page.path(best[0][1]) if best else None
        text = _text(page, page.at(path) if path else {0})
    return text, path


def _text(page: Page, keep: set[int]) -> str:
    return " ".join(t for _, t, _ in blocks(page, keep)) if keep else ""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, in lower case (A-Z); empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def votes(pages: DataFrame) -> DataFrame:
    """host, path, vote: the paths of all that a page's containers stand in, with their shares of its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[str, str], float] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parsed(html.as_py() or "")
                best = container_scores(page)
                total = sum(score for score, _ in best)
                for score, k in best:
                    path = page.path(k)
                    out[host, path] = out.get((host, path), 0) + score / total
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([p for _, p in out], pa.string()), pa.array(list(out.values()), pa.float64())], names=["host", "path", "vote"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, vote double")


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, path."""
    pages = require(pages, "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    total = votes(pages).groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"))
    won = written(total.groupBy("host").agg(F.max(F.struct("vote", "path"))["path"].alias("path")), "html-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(html.as_py() or "", path) for html, path in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([p for _, p in got], pa.string())], names=["page_id", "url", "text", "path"])

    # By merge at every size, so that a host with a third of the pages is split by the adaptive planner.
    joined = pages.join(won.hint("merge"), "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string, path string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
