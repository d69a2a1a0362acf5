"""HTML extraction: the best contiguous content region of a page by a maximum-scoring subsequence.

A page is read as a row of words and tags, each with a weight that is learned from pages whose article element marks
the content. A word's weight follows from its block, the length of that block and whether it is in a link, and from its
place: inside the article, beside one, or on a page without one, which is scored as if nothing were known. Words beside an
article and in short blocks of links come out negative, and so do tags. One linear scan finds the contiguous
stretch with the highest sum, whose blocks are the text. Page furniture (menus, adverts, comments and so on, told by
element, role and name) counts against the stretch and is no part of its text; inside an article it is passed over.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices

#: Marked pages that weights are learned from, at most (the smallest by hash of page id and url).
TRAINING_PAGES = 2000
#: The score of a word or tag that the marked pages don't show, by its place: on a page without an article, inside one, beside one.
UNSEEN_WORD, UNSEEN_TAG = {"": 0.5, "i": 0.5, "o": -0.5}, {"": -0.05, "i": -0.01, "o": -0.5}
#: How much a tag that is never in an article costs.
TAG_COST = 4.0
#: Words from which on a block counts as longer, and the share of a page's words that its article holds at least.
LENGTHS, ARTICLE_SHARE = (4, 11, 26), 1 / 3

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("aside button datalist dialog footer head header iframe menu nav object select title".split())
#: Elements whose content is not markup: it runs to the end tag, or to the end of the page.
RAW = frozenset("script style textarea iframe".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in RAW}
#: Elements that are passed over whole (2), or whose tags alone are (1).
PASSED = dict.fromkeys("noscript template svg object canvas audio video".split(), 2) | {"math": 1}
#: Where a vector graphic or formula holds HTML again, and the tags that end one that was left open (as in the HTML standard).
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
#: What may stand in the head, and which items end one another unless a new list or table begins.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
ITEMS = {"li": "li", "dd": "d", "dt": "d", "td": "t", "th": "t", "option": "option"}
LISTS = frozenset("ul ol menu dir dl table select tr datalist".split())
#: Start tags that don't end an open paragraph, though they are blocks.
IN_PARAGRAPH = frozenset("body caption head html legend option optgroup tbody td tfoot th thead title tr".split())

#: Fixed lists of the words that names (class and id) are made of. Plain furniture, furniture unless the element is named or filled
#: like content, content, and words that go with any of them.
PLAIN = frozenset(
    "ad ads adsbygoogle adsense adunit advert adverts advertisement advertisements advertising adbox adslot banner banners breadcrumb breadcrumbs comment commentarea comments commentlist commenter consent cookie cookieconsent cookies "
    "dfp disqus footer gdpr menu menus modal nav navbar navigation newsletter outbrain pagination pager paid popup respond replies sidebar sitenav sponsor sponsored sponsors subscribe taboola toolbar".split()
)
DOUBTFUL = frozenset("copyright disclaimer header login masthead notice notices promo promos promotion related search share sharing signup skip social widget widgets".split())
#: Furniture on elements that only group, but a section of a text or its heading may be called so.
TALK = frozenset("discussion discussions responses".split())
CONTENT = frozenset("article articles body content entry hentry main page post prose story text".split())
NEUTRAL = frozenset(
    "area author bar blog block bottom box btn button buttons card cell center col column container content count desktop fb fixed float form global google group icon icons inner item items js large "
    "left link links list main meta mobile new outer overlay panel policy primary reader reply right row secondary section site slot small span sticky thread title to top unit user web wp wrap wrapper".split()
)
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]*+)))?""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_TO_QUOTE = re.compile(r"""[^>"']*+""")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named(value: str, grouping: bool) -> int:
    """2 if one of the names is plain furniture, 1 if one is doubtful, else 0; 0 as well if another name is that of content.

    A name is furniture only if all its parts are furniture or neutral: "comment-list" is, "search-engines-article" isn't. Parts
    count together too ("side-bar").
    """
    level = 0
    for name in value.split():
        parts = [p for p in _PARTS.split(_CAMEL.sub("-", name).lower()) if p]
        if not parts:
            continue
        if all(p in CONTENT for p in parts):
            return 0
        if "".join(parts) in PLAIN or (grouping and "".join(parts) in TALK):
            level = 2
        elif all(p in PLAIN or p in DOUBTFUL or p in NEUTRAL or p in CONTENT for p in parts):
            level = max(level, 2 if any(p in PLAIN for p in parts) else int(any(p in DOUBTFUL for p in parts)))
    return level


def _furniture(name: str, attributes: str) -> int:
    """2 for page furniture, 1 for an element that may be, 0 for others."""
    level = 2 if name in FURNITURE else 1 if name == "form" else 0
    if level == 2 or not attributes or name in ("html", "body"):
        return level
    kept = name in HEADINGS or name in ("article", "main", "section")
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDING.search(value)):
            return 2
        if key == "role" and value.lower() in ROLES:
            return 2
        if key in ("class", "id"):
            found = _named(value, not kept)
            if found == 1 and (name in HEADINGS or name in ("article", "main")):
                found = 0
            level = max(level, found)
    return level


@dataclass
class Token:
    """A run of text (key "w:" and its block) or a tag (key its name, with a slash if it ends something)."""

    key: str
    text: str
    dropped: bool  # inside page furniture
    marked: bool  # inside an article or main element
    doubt: int = 0  # the innermost element around that may be furniture
    link: bool = False
    words: int = 0
    place: str = ""  # "i" inside the page's article, "o" beside it, "" on a page without one
    length: int = 0  # of its block, as a step of LENGTHS


@dataclass
class _Open:
    name: str = ""
    block: str = "body"
    dropped: bool = False
    marked: bool = False
    doubt: int = 0
    passed: int = 0
    foreign: bool = False
    paragraph: int = -1  # place in the stack of the open paragraph, and of the open item, that a new one ends
    item: int = -1


@dataclass
class _Page:
    page: str
    tokens: list[Token] = field(default_factory=list)
    doubts: list[int] = field(default_factory=lambda: [0])  # of each doubtful element, the doubtful one around it
    stack: list[_Open] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    quoting: bool = True

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _ROOT

    def pop_to(self, place: int) -> None:
        for element in self.stack[place:]:
            self.open[element.name] -= 1
        del self.stack[place:]

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag, or -1. If quotes are left open, tags end at the next > from there on."""
        page, here = self.page, at
        while self.quoting:
            here = _TO_QUOTE.match(page, here).end()
            if here == len(page):
                self.quoting = False
            elif page[here] == ">":
                return here
            else:
                close = page.find(page[here], here + 1) if page[max(at, here - 8) : here].rstrip()[-1:] == "=" else here  # else it is no value's
                if close < 0:
                    self.quoting = False
                here = close + 1
        return page.find(">", at)

    def text(self, start: int, end: int) -> None:
        top = self.top()
        if end > start and top.passed < 2:
            body = self.page[start:end]
            self.tokens.append(Token(f"w:{top.block}", body, top.dropped, top.marked, top.doubt, self.open["a"] > 0, len(body.split())))

    def tag(self, key: str) -> None:
        top = self.top()
        if not top.passed and key.lstrip("/") not in PASSED:
            self.tokens.append(Token(key, "", top.dropped, top.marked, top.doubt))

    def end(self, name: str) -> None:
        self.tag(f"/{name}")
        if self.open[name]:
            place = len(self.stack) - 1
            while self.stack[place].name != name:
                place -= 1
            self.pop_to(place)

    def begin(self, name: str, attributes: str) -> None:
        top = self.top()
        if top.foreign and name in BREAKOUT:
            while self.stack and self.stack[-1].foreign:
                self.pop_to(len(self.stack) - 1)
            top = self.top()
        if self.open["head"] and not top.foreign and (name == "body" or (top.name == "head" and name not in IN_HEAD)):
            self.pop_to(next(k for k, e in enumerate(self.stack) if e.name == "head"))
            top = self.top()
        if not top.foreign:
            if name in BLOCK and name not in IN_PARAGRAPH and top.paragraph >= 0:
                self.pop_to(top.paragraph)
                top = self.top()
            if name in ITEMS and top.item >= 0 and ITEMS[self.stack[top.item].name] == ITEMS[name]:
                self.pop_to(top.item)
                top = self.top()
        if name not in VOID and not (attributes.endswith("/") and (top.foreign or name in ("svg", "math"))):
            level = 0 if name == "header" and top.marked else _furniture(name, attributes)
            new = _Open(name, name if name in BLOCK else top.block, top.dropped or level == 2, top.marked or name in ("article", "main"), top.doubt, max(top.passed, PASSED.get(name, 0)))
            new.foreign = name in ("svg", "math") or (top.foreign and name not in INTEGRATION)
            if name in ("article", "main"):
                new.doubt = 0
            if level == 1 and not new.dropped:
                new.doubt = len(self.doubts)
                self.doubts.append(top.doubt)
            new.paragraph = len(self.stack) if name == "p" else -1 if name in ("td", "th", "caption", "button", "object", "svg", "math") else top.paragraph
            new.item = len(self.stack) if name in ITEMS else -1 if name in LISTS else top.item
            self.stack.append(new)
            self.open[name] += 1
        self.tag(name)


_ROOT = _Open()


def page_tokens(page: str) -> list[Token]:
    """The words and tags of a page in order, in time that grows with its length, however broken it is."""
    state, at, size = _Page(page), 0, len(page)
    while True:
        opens = page.find("<", at)
        start = at
        while 0 <= opens < size - 1 and not (page[opens + 1] in "/!?" or page[opens + 1].isalpha()):
            opens = page.find("<", opens + 1)  # a bare less-than sign
        if opens < 0 or opens >= size - 1:
            state.text(start, size)
            break
        state.text(start, opens)
        if page.startswith("<!--", opens):
            at = page.find("-->", opens + 2) + 3
            if at < 3:
                break
            continue
        m = _NAME.match(page, opens + 1)
        if m is None:
            at = page.find(">", opens) + 1
            if not at:
                break
            continue
        end = state.tag_end(m.end())
        if end < 0:
            break  # a tag that never ends, as the HTML standard has it
        at, name = end + 1, m.group().lower()
        attributes = page[m.end() : end].rstrip()
        if name[0] == "/":
            state.end(name[1:])
        elif name in RAW and not (state.top().foreign and attributes.endswith("/")):
            at = RAW_END[name].search(page, at).end()
        else:
            state.begin(name, attributes)
    return _placed(_judged(state))


def _judged(state: _Page) -> list[Token]:
    """Elements that may be furniture are, unless they hold most words of a page without an article or main element."""
    if len(state.doubts) == 1:
        return state.tokens
    words, total, marked = [0] * len(state.doubts), 0, False
    for t in state.tokens:
        if t.words and not t.dropped:
            words[t.doubt] += t.words
            total += t.words
            marked = marked or t.marked
    for k in range(len(words) - 1, 0, -1):
        words[state.doubts[k]] += words[k]
    drop = [False] * len(words)
    for k in range(1, len(words)):
        drop[k] = drop[state.doubts[k]] or marked or 2 * words[k] <= total
    for t in state.tokens:
        t.dropped = t.dropped or drop[t.doubt]
    return state.tokens


def _placed(tokens: list[Token]) -> list[Token]:
    """Each token's place, and the length of each word's block. A page has an article if that holds a third of the words at least."""
    inside = sum(t.words for t in tokens if t.marked and not t.dropped)
    total = sum(t.words for t in tokens if not t.dropped)
    has = inside > 0 and inside >= ARTICLE_SHARE * total
    block: list[Token] = []

    def close() -> None:
        length = bisect_right(LENGTHS, sum(t.words for t in block))
        for t in block:
            t.length = length
        block.clear()

    for t in tokens:
        t.place = ("i" if t.marked else "o") if has else ""
        if t.text:
            block.append(t)
        elif t.key.lstrip("/") in BLOCK:
            close()
    close()
    return tokens


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous scores with the highest sum (the first to end of equals); (0, -1) if none is positive."""
    best, first, last = 0.0, 0, -1
    total, start = 0.0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, first, last = total, start, k
    return first, last


def _keys(t: Token, place: str) -> list[str]:
    """The keys of a token's weight, the most telling first."""
    if not t.text:
        return [f"{t.key}:{place}", f"tag:{place}", t.key] if place else [t.key]
    seen = f"{t.length}{'a' if t.link else ''}{place}"
    return [f"{t.key}:{seen}", f"w::{seen}", *([f"w::{place}"] if place else []), t.key]


def score(t: Token, weights: dict[str, float]) -> float:
    for key in _keys(t, t.place):
        if key in weights:
            return weights[key] * (t.words if t.text else 1)
    return UNSEEN_WORD[t.place] * t.words if t.text else UNSEEN_TAG[t.place]


def extract(page: str, weights: dict[str, float], region: Callable[[list[float]], tuple[int, int]] = best_region) -> str:
    """The blocks of the best region without page furniture, one a line."""
    blocks: list[list[str]] = [[]]
    scores, places = [], []
    for t in page_tokens(page):
        if not t.text:
            name = t.key.lstrip("/")
            if name in BLOCK and blocks[-1]:
                blocks.append([])
            elif name == "br":
                blocks[-1].append(" ")
        elif not t.dropped:
            blocks[-1].append(t.text)
        if not (t.dropped and t.marked):
            scores.append(min(score(t, weights), 0.0) if t.dropped else score(t, weights))
            places.append(len(blocks) - 1)
    first, last = region(scores)
    found = blocks[places[first] : places[last] + 1] if last >= 0 else ()
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in found)
    return "\n".join(x for x in lines if x)


#: Tags that have a weight of their own; with the blocks they bound the number of weights.
_WEIGHED = BLOCK | VOID | frozenset("a abbr b big cite code del em font i ins kbd mark q s small span strong sub sup time u".split())


def _learn(batches):
    """How often each key stands inside an article and outside; furniture inside one doesn't count. Pages whose article is none teach nothing."""
    inside, outside = Counter(), Counter()
    for part in slices(batches, "html"):
        for page in part.column("html").to_pylist():
            for t in page_tokens(page):
                if not t.place or (t.dropped and t.marked) or not (t.words or (not t.text and t.key.lstrip("/") in _WEIGHED)):
                    continue
                for key in {*_keys(t, t.place), *_keys(t, "")}:
                    (inside if t.marked else outside)[key] += t.words or 1
    keys = sorted(set(inside) | set(outside))
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], ["key", "inside", "outside"])


def learn_weights(pages: DataFrame, rows: int = TRAINING_PAGES) -> dict[str, float]:
    """Weights of words (by block, its length, links and place, and by less of these) and of tags, from at most so many pages with an article element.

    With p the share of a key's occurrences that lie inside, a word weighs 2 p - 1 and a tag -(1 - p) times TAG_COST,
    less a little. Furniture beside the article counts outside. Keys are made of names of known elements and a few steps, so the result has a fixed bound.
    """
    marked = pages.where(F.col("html").contains("<article")).withColumn("_order", F.xxhash64(F.col("page_id").cast("string"), F.col("url")))
    last = marked.select("_order").orderBy("_order").limit(rows).agg(F.max("_order")).first()[0]
    sample = marked.where(F.col("_order") <= F.lit(last)).select("html")
    found = sample.mapInArrow(_learn, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    weights = {}
    for r in found:
        share = (r["inside"] + 1) / (r["inside"] + r["outside"] + 2)
        weights[r["key"]] = 2 * share - 1 if r["key"].startswith("w:") else -0.01 - TAG_COST * (1 - share) * (1 if r["outside"] else 0)
    return weights


def _extract(batches, weights: dict[str, float]):
    for part in slices(batches, "html"):
        found = [extract(page, weights) for page in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per page row: page_id, url, text and n_chars (code points).

    Null or empty html, and pages without content, give an empty text; repeated rows are each extracted;
    other columns are ignored. Without weights they are learned from the pages themselves.
    """
    learned = learn_weights(pages) if weights is None else weights
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(lambda batches: _extract(batches, learned), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
