"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tokens: words, which score positive, and tags, which
score negative. One linear scan finds the contiguous region with the greatest
sum; whole blocks that it touches make up the text. Weights are log-odds of
lying inside the content, counted on labelled pages: those that mark their
content themselves with ``article`` or ``main``: ``SAMPLE`` of them, or all if
there are fewer, chosen by hash among the distinct ones, so that neither copies
nor pages without marks take up places. Fixed prior counts stand for what the
sample lacks. A word in a link weighs against.

On a page to be extracted a mark is evidence of bounded weight: tags in it weigh
nothing, and a plain word outside marks weighs as a plain word times 1 - 2 s, where s
is the share of the page's plain words that lie in marks. So where the marks have most
of the text, what is outside counts against, and where they have little of it, it counts
for. The scan gives all maximal scoring subsequences in one pass (Ruzzo and Tompa);
of a page with marks each one that has marked words is taken, else the best one.

Elements that are no content by their name, role or class (menus, headers, footers,
sidebars, notices, adverts, forms, comments) lie outside the text even within the
region. A class or id names such an element if all its parts do, beside words for
place and shape ("site-footer", not "content-sidebar-wrap" or "comments-open"). These
rules take out no element around a ``main``, around the page's longest marked
part, or with more words of its own outside links than the page has around it
(``nav``, ``aside`` and their like stay out however long, and so do readers' comments,
though they be longer than the text, or each an ``article``); a form around an
``article`` is no form. On a page without marks what lies in one list or in one such
element counts against ``SHARED_COST`` plain words at most, so a long list between two
parts of a text does not cut one off, and a title from which less than ``HEAD_COST``
plain words part the region belongs to it.

Defined results: null or empty html gives an empty text; a very long page is read
whole; of regions with equal sums the first counts; an empty table gives an empty
one (the weights are then the prior ones); broken markup is read
as far as it goes (an unclosed element ends with its parent, a tag cut off at
the end is dropped); repeated rows give equal values; a null url stays null;
other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 500
SHARED_COST, HEAD_COST = 30, 20

# Element names and words of class names, in HTML use.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
OUTSIDE = set("script style noscript template iframe head button select option textarea input object svg canvas audio video applet".split())
APART = set("nav footer aside dialog menu search".split())
CONTENT = {"article", "main"}
TEXTUAL = set("a p b i em strong h1 h2 h3 h4 h5 h6 br blockquote pre code q cite sub sup table tr td th tbody ul ol li dl dt dd figure figcaption span u".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert toast newsletter subscribe subscription signup login popup modal overlay sidebar sidenav rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond reply replies social share sharing related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer".split()
)
BESIDE_WORDS = set(
    "top bottom left right upper lower site page main primary secondary global mobile desktop header inner outer box area bar block section container wrap wrapper slot unit list item items link links button buttons btn icon icons title heading active close form post posts article articles story stories entry column col row".split()
)
COMMENT_WORDS = set("comment comments disqus respond reply replies".split())
LISTS = set("ul ol dl table menu select".split())
HEADER_WORDS = {"site", "global", "main", "top", "wrap", "wrapper", "inner", "container"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'>/=]+)""")
_WORDS = re.compile("[^a-z]+")
_CLOSES_P = BLOCK - {"li", "td", "th", "tr", "option", "dd", "dt", "caption", "tbody", "thead", "tfoot", "body", "html", "head"}
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _named(token: str, in_content: bool) -> bool:
    """All parts of a class or id say that the element is no content."""
    parts = {x for x in _WORDS.split(token) if len(x) > 1}
    if parts & OUTSIDE_WORDS and parts <= OUTSIDE_WORDS | BESIDE_WORDS:
        return True
    return "header" in parts and not in_content and parts <= HEADER_WORDS | {"header"}


def _outside(name: str, attributes: str, in_content: bool) -> str:
    """How the element is no content by its name, role or class: "never" is text,
    "apart", "comment" or "named"; "" if it may be."""
    if name in OUTSIDE:
        return "never"
    how = "apart" if name in APART else "named" if name == "form" or name == "header" and not in_content else ""
    if not attributes or name in ("html", "body"):
        return how
    for m in _ATTR.finditer(attributes):
        key = (m[1] or m[5]).lower()
        if key == "hidden":
            return "never"
        value = next((v for v in m.groups()[1:4] if v), "").lower()
        if key in ("class", "id") and any(COMMENT_WORDS & set(_WORDS.split(one)) and _named(one, in_content) for one in value.split()):
            return "comment"
        if name in CONTENT:
            continue
        if key == "role" and value in OUTSIDE_ROLES:
            how = how or ("named" if value == "form" else "apart")
        elif key in ("class", "id") and not how and any(_named(one, in_content) for one in value.split()):
            how = "named"
    return how


@dataclass
class Token:
    """A tag (its name) or a run of text. place: "out", "link", "in" (a mark of
    content) or "plain". block: the number of the block that a run belongs to.
    inside: of "out", the element that is no content lies in a mark of content.
    group: the outermost list or element that is no content around it, or 0. head: it
    lies in an h1."""

    tag: str = ""
    text: str = ""
    words: int = 0
    place: str = "plain"
    block: int = 0
    inside: bool = False
    group: int = 0
    head: bool = False


@dataclass
class _Part:
    """An element that is no content by its name, role or class, unless it holds too
    much of the page. around: the next one around it. words, marked, main: its words
    outside links, in marks of content and in ``main``, without those of parts in it
    that are left out; whole: its words outside links with those."""

    around: int
    form: bool = False
    apart: bool = False
    comment: bool = False
    in_content: bool = False
    in_main: bool = False
    words: int = 0
    marked: int = 0
    main: int = 0
    whole: int = 0
    out: bool = False
    inside: bool = False


def _settle(parts: list[_Part]) -> None:
    """Which parts are left out. The first is the page; others follow those around them."""
    page, longest = parts[0], max(p.marked for p in parts)
    everything = page.words
    for p in parts[1:]:
        p.whole = p.words
        p.apart = p.apart or parts[p.around].apart
        p.comment = p.comment or parts[p.around].comment
        everything += 0 if p.apart or p.comment else p.words
    named = [not p.apart and not p.comment for p in parts]
    for i in range(len(parts) - 1, 0, -1):
        p, q = parts[i], parts[parts[i].around]
        holds_mark = not p.in_main and p.main or not p.in_content and p.marked and (p.form or p.marked >= longest)
        p.out = p.comment or not holds_mark and not (named[i] and p.words > everything - p.whole)
        if named[i]:
            q.whole += p.whole
        if not p.out:
            q.words, q.marked, q.main = q.words + p.words, q.marked + p.marked, q.main + p.main
    for p in parts[1:]:
        q = parts[p.around]
        p.inside = q.inside if q.out else p.in_content
        p.out = p.out or q.out


@dataclass
class _State:
    open: list[tuple[str, str, int, int]] = field(default_factory=list)
    group: int = 0
    groups: int = 0
    head: int = 0
    never: int = 0
    content: int = 0
    main: int = 0
    link: int = 0
    part: int = 0
    parts: list[_Part] = field(default_factory=lambda: [_Part(0)])

    def push(self, name: str, outside: str) -> None:
        self.open.append((name, outside, self.part, self.group))
        if outside in ("apart", "named", "comment"):
            self.parts.append(_Part(self.part, name == "form", outside == "apart", outside == "comment", self.content > 0, self.main > 0))
            self.part = len(self.parts) - 1
        if not self.group and (name in LISTS or outside in ("apart", "comment")):
            self.groups += 1
            self.group = self.groups
        self.head += name == "h1"
        self.never += outside == "never"
        self.content += name in CONTENT and outside != "comment"
        self.main += name == "main"
        self.link += name == "a"

    def pop(self) -> None:
        name, outside, self.part, self.group = self.open.pop()
        self.head -= name == "h1"
        self.never -= outside == "never"
        self.content -= name in CONTENT and outside != "comment"
        self.main -= name == "main"
        self.link -= name == "a"

    def count(self, words: int) -> None:
        p = self.parts[self.part]
        p.words += 0 if self.link else words
        p.marked += words if self.content else 0
        p.main += words if self.main else 0

    def close(self, name: str, within: set[str] = frozenset()) -> None:
        """Closes the innermost such element and what is open inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in within:
                return


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    parts: list[int] = []  # of each token
    s, block, at = _State(), 0, 0

    def add(t: Token) -> None:
        if s.never:
            t.place, t.inside = "out", s.content > 0
        else:
            t.place = "in" if s.content else "link" if s.link and not t.tag else "plain"
        t.group, t.head = s.group, s.head > 0
        out.append(t)
        parts.append(s.part)

    def text(raw: str) -> None:
        if raw:
            decoded = html.unescape(raw)
            words = len(decoded.split())
            if not s.never:
                s.count(words)
            add(Token("", decoded, words, block=block))

    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        block += name in BLOCK
        if m[1]:
            s.close(name)
        else:
            if name in _CLOSES_P:
                s.close("p", {"article", "main", "section", "div", "td", "th", "li", "blockquote", "body", "button", "figure", "form", "aside", "nav", "header", "footer"})
            if name == "a":
                s.close("a", {"p", "div", "li", "td", "article", "nav", "section", "body"})
            if name not in VOID and not m[3].endswith("/"):
                s.push(name, _outside(name, m[3], s.content > 0))
                if name in RAW:
                    end = _END[name].search(page, at)
                    at = end.start() if end else len(page)
        add(Token(name))
    text(page[at:])
    _settle(s.parts)
    for t, i in zip(out, parts):
        if s.parts[i].out:
            t.place, t.inside = "out", s.parts[i].inside
    return out


@dataclass
class Weights:
    tags: dict[str, float]
    words: dict[str, float]

    def of(self, t: Token, outside: float) -> float:
        """outside: by what a plain word outside marks is multiplied."""
        if t.inside or t.tag and t.place in ("in", "out"):
            return 0.0
        if t.tag:
            return self.tags.get(t.tag, self.tags[""])
        return t.words * self.words[t.place] * (outside if t.place == "plain" else 1)


def _odds(inside: float, outside: float) -> float:
    return max(-3.0, min(3.0, math.log(inside / outside)))


#: Prior counts (inside, outside): tags that format text, other tags, and words by place.
PRIOR_TEXTUAL, PRIOR_OTHER = (4, 5), (1, 6)
PRIOR_WORDS = {"in": (20, 1), "plain": (20, 5), "link": (2, 20), "out": (1, 20)}


def weights(pages: list[str]) -> Weights:
    """From pages that mark their content; others are passed over. Words weigh at
    least 0.1 for or against, tags at least 0.01 against; a word in a link weighs no more
    against than a plain word weighs for, so that a list of links does not cut a text off."""
    tags: Counter = Counter()
    words: Counter = Counter()
    for page in pages:
        found = tokens(page)
        if not any(t.place == "in" for t in found):
            continue
        for t in found:
            if t.tag and t.place != "out":
                tags[t.tag, t.place == "in"] += 1
            elif not t.tag:
                words["link" if t.place == "link" else "plain" if t.place != "out" else "out", t.place == "in"] += t.words
    names = {n for n, _ in tags} | TEXTUAL
    prior = lambda n: PRIOR_TEXTUAL if n in TEXTUAL else PRIOR_OTHER
    by_tag = {n: min(-0.01, _odds(prior(n)[0] + tags[n, True], prior(n)[1] + tags[n, False])) for n in names - CONTENT}
    by_tag[""] = _odds(*PRIOR_OTHER)
    by_word = {}
    for place, (i, o) in PRIOR_WORDS.items():
        w = _odds(i + words[place, True], o + words[place, False])
        by_word[place] = max(0.1, w) if place in ("in", "plain") else min(-0.1, w)
    by_word["link"] = max(by_word["link"], -by_word["plain"])
    return Weights(by_tag, by_word)


def maximal(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, sum), from left to right, in one
    pass: the best one, the best ones of what is left on its sides, and so on."""
    found: list[tuple[int, int, float, float, int]] = []  # with the sums before and after, and the last one with less before
    total = 0.0
    for i, x in enumerate(scores):
        if x > 0:
            start, low, high = i, total, total + x
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= low:
                    j = found[j][4]
                if j < 0 or found[j][3] >= high:
                    found.append((start, i + 1, low, high, j))
                    break
                start, low = found[j][0], found[j][2]
                del found[j:]
        total += x
    return [(a, b, high - low) for a, b, low, high, _ in found]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The first contiguous region with the greatest positive sum, or (0, 0)."""
    return max(maximal(scores), key=lambda r: r[2], default=(0, 0, 0.0))[:2]


def scored(found: list[Token], w: Weights) -> list[float]:
    """A score a token; without marks what counts against in one group ends at ``SHARED_COST`` words."""
    inside = sum(t.words for t in found if t.place == "in")
    beside = sum(t.words for t in found if t.place == "plain" and not t.tag)
    outside = 1 - 2 * inside / max(1, inside + beside)
    out, spent, most = [], {}, SHARED_COST * w.words["plain"]
    for t in found:
        x = w.of(t, outside)
        if x < 0 and t.group and not inside:
            x = max(x, spent.get(t.group, 0.0) - most)
            spent[t.group] = spent.get(t.group, 0.0) - x
        out.append(x)
    return out


def regions(found: list[Token], w: Weights) -> list[tuple[int, int]]:
    """The parts of the page that make up its text, from first to last."""
    scores = scored(found, w)
    all_ = maximal(scores)
    if not all_:
        return []
    marked = [0]
    for t in found:
        marked.append(marked[-1] + (t.words if t.place == "in" else 0))
    with_marks = [(a, b) for a, b, _ in all_ if marked[b] > marked[a]]
    if with_marks:
        return with_marks
    start, end, _ = max(all_, key=lambda r: r[2])
    if not any(t.head for t in found[start:end]):
        cost, most = 0.0, HEAD_COST * w.words["plain"]
        for i in range(start - 1, -1, -1):
            if found[i].head and found[i].words and found[i].place != "out":
                while i > 0 and found[i - 1].head:
                    i -= 1
                start = i
                break
            cost += abs(scores[i])
            if cost > most:
                break
    return [(start, end)]


def main_text(page: str | None, w: Weights) -> str:
    found = tokens(page or "")
    touched = {t.block for start, end in regions(found, w) for t in found[start:end] if t.words and t.place != "out"}
    blocks: dict[int, list[str]] = {}
    for t in found:
        if not t.tag and t.block in touched and t.place != "out":
            blocks.setdefault(t.block, []).append(t.text)
        elif t.tag in ("br", "img", "hr", "wbr") and blocks:
            blocks[next(reversed(blocks))].append(" " if t.tag != "wbr" else "")
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def learn(pages: DataFrame, sample: int = SAMPLE, html_col: str = "html") -> Weights:
    """Weights from a bounded sample of distinct pages that mark their content. A
    threshold on the hash, from the number of such pages, leaves about four times as
    many as are taken, which is what has to be made distinct and sorted."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]")).select(F.col(html_col).alias("h"))
    n = marked.select(F.xxhash64("h").alias("k")).distinct().count()
    share = min(1.0, 4 * sample / max(1, n))
    few = marked.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000_000)) < int(1_000_000_000 * share)).distinct()
    rows = few.orderBy(F.xxhash64("h"), "h").limit(sample).collect()
    return weights([r["h"] for r in rows])


def extract(pages: DataFrame, w: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): every page's main text."""
    w = w or learn(pages, html_col=html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), w) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{kinds}, text string, n_chars long")
