"""HTML extraction by wrappers: union-free regular expressions that pages of one host have in common.

Pages of a host are aligned one after another. Elements, or runs of elements, that follow themselves become repeated
groups; what only one side has becomes optional; texts that differ become slots, texts that never do stay as they are. Of
the expression that results, the element that holds the article's slots is found; a page is read by looking for the
element that stands in its place, among siblings of the same name by what they hold. Where a page has no such element, it
is read by an expression of its own.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, staged

#: Pages of a host that its wrapper is inferred from; tokens and depth of a page beyond which it teaches nothing, but is read all the same; hosts whose wrappers are broadcast at most.
SAMPLE_PAGES, MAX_TOKENS, MAX_DEPTH, BROADCAST_HOSTS = 16, 20_000, 100, 20_000
#: Share of an element's slot text that a child must have for the article to be sought in the child; elements of a run that can be a repeated group.
INWARD, RUN = 0.7, 8
#: Where an article is a smaller share than this of what a form or object holds, that is the article.
LITTLE = 0.1

# Kinds of element, and words of classes and ids that are not the article.
#: Elements in which the article is sought further inwards.
INNER = frozenset("html body div section main article table tbody tr td center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
FOREIGN = frozenset("svg math".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog label input datalist noscript template svg math canvas object audio video".split())
#: Elements that an open p outside of them is not ended from.
SCOPES = frozenset("table td th caption button object template html".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - {"html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title"}
#: Of these an element is transparent where next to nothing is left of a page without what it holds.
CONTAINERS = frozenset("form object dialog".split())
#: An element is aside if every part of one of its classes, or of its id, is one of these words or fillers and at least one of the first.
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promotions banner sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent notice notices gdpr popup modal overlay subscribe subscription newsletter signup login social share sharing related recommended recommendation recommendations comment comments disqus respond replies pagination pager toolbar widget widgets".split())
ASIDE_FILLERS = frozenset("a the us to on site page post posts article articles top bottom left right main inner outer box bar block list links link item items button buttons form section area wrap wrapper container content panel slot unit row text title media follow icons".split())
#: More of them outside of an article, where texts are what they may be about and are no fillers.
OUTER_WORDS = ASIDE_WORDS | frozenset("side masthead header footer foot alert reply skip legal copyright disclaimer".split())
OUTER_FILLERS = ASIDE_FILLERS - {"text", "article", "articles", "post", "posts", "content", "section"} | frozenset("nav links primary secondary second first global bg fixed sticky mobile desktop wide narrow col column count info meta note message body".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu".split())

CONTAINER = re.compile("<(?:" + "|".join(sorted(CONTAINERS)) + ")", re.IGNORECASE)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*+)>|[^<]++|<", re.DOTALL)
UNENDED = re.compile(r"<(?=[A-Za-z/!?])")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(rest)} if rest else {}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" or "void", tag, attributes as written), ("close", tag, ""), ("text", text, ""); without comments, scripts and other raw content.

    Each character is passed a bounded number of times: behind the last ">" there are no more tags to look for, and an end
    tag that was not found once is not sought again. Of raw elements that never end, scripts and styles hold the rest of
    the page, of others the start tag alone is passed over.
    """
    at, last, endless = 0, page.rfind(">"), set()
    while at <= last and (m := TOKEN.match(page, at)):
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                yield "close", tag, ""
            elif tag in VOID or m["rest"].endswith("/") and tag in FOREIGN:
                yield "void", tag, m["rest"]
            elif tag in RAW:
                end = None if tag in endless else re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                    at = len(page) if tag in ("script", "style") else at
            else:
                yield "open", tag, m["rest"]
        elif m[0][:2] not in ("<!", "<?"):
            yield "text", m[0], ""
    if at < len(page):
        # no tag ends here any more; what begins one is markup
        yield "text", UNENDED.split(page[at:], 1)[0], ""


def _signature(tag: str, given: dict[str, str]) -> str:
    """A tag with its classes and id, numbers left out."""
    words = re.sub(r"\d+", "", f"{given.get('class', '')} {given.get('id', '')}").split()
    return ".".join([tag, *sorted(set(words))])


def _aside(tag: str, given: dict[str, str], inside: bool, depth: int, lenient: int = 0) -> bool:
    """Whether an element, inside the article or not, is something else than article. A header near the root is the site's.
    lenient: 1 if containers are transparent, 2 if classes, ids and roles say nothing either."""
    if tag in DROPPED and not (lenient and tag in CONTAINERS) or (tag == "header" and not inside and depth <= 3):
        return True
    if not given:
        return False
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    if tag in ("html", "body", "main") or given.get("role") == "main" or lenient > 1:
        return False
    if given.get("role") in ASIDE_ROLES - ({"form", "dialog"} if lenient else set()):
        return True
    words, all_words = (ASIDE_WORDS, INNER_NAMES) if inside else (OUTER_WORDS, OUTER_NAMES)
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = [x for x in re.sub(r"\d+", "", name).replace("_", "-").lower().split("-") if x]
        if parts and not words.isdisjoint(parts) and all_words.issuperset(parts):
            return True
    return False


INNER_NAMES, OUTER_NAMES = ASIDE_WORDS | ASIDE_FILLERS, OUTER_WORDS | OUTER_FILLERS


def _of_another(key: str) -> bool:
    return key.startswith(("nav", "aside", "footer", "form")) or ".comment" in key


@dataclass
class Events:
    """Walks a page's tokens with a stack of open elements that HTML's implied ends keep right."""

    page: str
    lenient: int = 0
    keys: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    asides: list[bool] = field(default_factory=list)
    articles: int = 0
    places: dict[str, list[int]] = field(default_factory=dict)  # of the open elements of each tag
    others: int = 0  # open elements by which an article that begins inside is no article of the page

    def pop_to(self, size: int) -> None:
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.articles -= tag in ("article", "main")
            self.places[tag].pop()
            self.others -= _of_another(self.keys.pop())
            self.asides.pop()

    def last(self, *tags: str) -> int:
        """Where the innermost open element of these tags is; -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def __iter__(self) -> Iterator[tuple[str, str]]:
        """("open", tag), ("close", tag), ("void", tag), ("text", text), when the stack has been brought up to date."""
        for kind, tag, rest in tokens(self.page):
            if kind == "text":
                yield "text", tag
            elif kind == "void":
                yield "void", tag
            elif kind == "open":
                if tag in ENDS_P and (p := self.last("p")) > self.last(*SCOPES):
                    self.pop_to(p)
                for other in CLOSED_BY.get(tag, ()):
                    if self.tags and self.tags[-1] == other:
                        self.pop_to(len(self.tags) - 1)
                given = attributes(rest)
                aside = _aside(tag, given, self.articles > 0, len(self.tags), self.lenient)
                # an article begins anew even where something before it was left open
                outer = bool(self.asides) and self.asides[-1] and not (tag in ("article", "main") and not self.others)
                self.keys.append(_signature(tag, given))
                self.places.setdefault(tag, []).append(len(self.tags))
                self.tags.append(tag)
                self.others += _of_another(self.keys[-1])
                self.asides.append(aside or outer)
                self.articles += tag in ("article", "main")
                yield "open", tag
            elif (at := self.last(tag)) >= 0:
                self.pop_to(at)
                yield "close", tag


@dataclass
class Item:
    """A part of a wrapper: an element (key, kids), a run of elements (kids alone) or a text (neither). A text stays as it is
    while constant is a string, and is a slot when None. chars are those of all pages that it was seen on."""

    key: str
    kids: list[Item] = field(default_factory=list)
    aside: bool = False
    repeated: bool = False
    optional: bool = False
    constant: str | None = None
    chars: int = 0
    pages: int = 1
    linked: bool = False

    @property
    def name(self) -> str:
        """What alignment goes by."""
        return self.key or ("(" + " ".join(k.name for k in self.kids) + ")" if self.kids else "")


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def page_items(page: str) -> Item | None:
    """A page as a tree of items, groups that follow themselves folded; None if it is too large to teach."""
    root = Item("")
    stack, seen, events = [root], 0, Events(page)
    for kind, value in events:
        seen += 1
        if seen > MAX_TOKENS or len(events.tags) > MAX_DEPTH:
            return None
        if kind == "text":
            text = _clean(value)
            if text:
                stack = stack[: len(events.tags) + 1]
                stack[-1].kids.append(Item("", constant=text, chars=len(text), aside=bool(events.asides) and events.asides[-1], linked=bool(events.places.get("a"))))
        elif kind == "open":
            stack = stack[: len(events.tags)]
            item = Item(events.keys[-1], aside=events.asides[-1])
            stack[-1].kids.append(item)
            stack.append(item)
    _fold(root)
    return root


def _holds(item: Item) -> set[str]:
    """Keys of an item's children, runs opened."""
    return {x for k in item.kids for x in ([k.key] if k.key else _holds(k))}


def _alike(one: Item, two: Item) -> bool:
    """Whether two elements of one key can be the same part of a page: those without class and id must have a child in common."""
    a, b = _holds(one), _holds(two)
    return one.key == two.key and (one.key not in INNER or not a or not b or not a.isdisjoint(b))


def _fold(item: Item) -> None:
    """Elements, or runs of up to RUN elements, that follow themselves become one repeated group."""
    for kid in item.kids:
        _fold(kid)
    kids, folded, at = item.kids, [], 0
    names = [k.key for k in kids]
    while at < len(kids):
        # the run whose repetition covers most, of these the shortest; a text alone is no run
        best, end = 1, at + 1
        for size in range(1, min(RUN, (len(kids) - at) // 2) + 1):
            if not all(names[at : at + size]):
                break
            to = at + size
            while names[to : to + size] == names[at : at + size] and all(_alike(x, y) for x, y in zip(kids[at : at + size], kids[to : to + size])):
                to += size
            if to > max(end, at + size):
                best, end = size, to
        run = kids[at : at + best]
        for start in range(at + best, end, best):
            run = [align(x, y) for x, y in zip(run, kids[start : start + best])]
        if end == at + best:
            folded += run
        elif best == 1:
            run[0].repeated = True
            folded += run
        else:
            folded.append(Item("", run, aside=all(x.aside for x in run), repeated=True))
        at = end
    item.kids = folded


def _runs_like(kids: list[Item], other: list[Item]) -> list[Item]:
    """kids, with those that stand once where other has a repeated run as that run."""
    for run in (x for x in other if not x.key and x.kids and all(k.name != x.name for k in kids)):
        size, wanted = len(run.kids), [k.key for k in run.kids]
        for at in range(len(kids) - size + 1):
            if [k.key for k in kids[at : at + size]] == wanted:
                kids = [*kids[:at], Item("", kids[at : at + size], aside=all(k.aside for k in kids[at : at + size])), *kids[at + size :]]
                break
    return kids


def align(one: Item, two: Item, across: bool = False) -> Item:
    """The least wrapper of two items with the same name, of one page or across pages: differing texts become slots, what one side
    lacks optional."""
    out = Item(one.key, pages=one.pages + two.pages if across else max(one.pages, two.pages), aside=one.aside and two.aside, repeated=one.repeated or two.repeated, optional=one.optional or two.optional, chars=one.chars + two.chars, linked=one.linked and two.linked)
    if not one.key and not one.kids and not two.kids:
        out.constant = one.constant if one.constant == two.constant else None
        return out
    left, right = _runs_like(one.kids, two.kids), _runs_like(two.kids, one.kids)
    for kind, i, i2, j, j2 in SequenceMatcher(None, [k.name for k in left], [k.name for k in right], autojunk=False).get_opcodes():
        if kind == "equal":
            out.kids += [align(x, y, across) for x, y in zip(left[i:i2], right[j:j2])]
        else:
            for kid in left[i:i2] + right[j:j2]:
                kid.optional = True
                out.kids.append(kid)
    return out


def expression(item: Item) -> str:
    """The wrapper as text: #text for slots, (...)+ for repeated and (...)? for optional groups."""
    if not item.key and not item.kids:
        inner = "#text" if item.constant is None else item.constant
    else:
        inner = (f"<{item.key}>" if item.key else "") + "".join(map(expression, item.kids)) + (f"</{item.key}>" if item.key else "")
    inner = f"({inner})+" if item.repeated else inner
    return f"({inner})?" if item.optional else inner


def _weight(item: Item) -> int:
    """Characters of texts that are neither aside nor linked: those of slots, and of texts of one page alone, on all pages; of
    what is the same on several pages, and so the site's rather than the article's, a quarter, once."""
    if item.aside:
        return 0
    if item.kids:
        return sum(map(_weight, item.kids))
    if item.linked or item.key:
        return 0
    return item.chars if item.constant is None or item.pages == 1 else len(item.constant) // 4


def _named(item: Item, path: tuple[Item, ...]) -> list[tuple[int, tuple[Item, ...]]]:
    """Weight and path of the elements that say themselves that they are the article."""
    if item.key.split(".")[0] in ("article", "main") and not item.aside:
        return [(_weight(item), path)]
    return [x for kid in item.kids if kid.key for x in _named(kid, (*path, kid))]


def article_items(root: Item) -> list[Item]:
    """The elements from the page inwards to the one that holds the article."""
    weight, named = max(_named(root, ()), key=lambda x: (x[0], [i.key for i in x[1]]), default=(0, ()))
    path = list(named) if weight else []
    item = path[-1] if path else root
    while item.kids and (total := _weight(item)):
        if item.key.split(".")[0] == "article":
            break
        kid = max((k for k in item.kids if k.key and not k.repeated), key=_weight, default=None)
        if kid is None or _weight(kid) < INWARD * total or kid.key.split(".")[0] not in INNER:
            break
        path.append(kid)
        item = kid
    return path


def article_path(root: Item) -> list[list]:
    """For each element down to the article its key and, where siblings have the same, what each of these holds and which it is."""
    out, outer = [], root
    for item in article_items(root):
        same = [k for k in outer.kids if k.key == item.key]
        out.append([item.key, [sorted(_holds(k)) for k in same], next(i for i, k in enumerate(same) if k is item)] if len(same) > 1 else [item.key])
        outer = item
    return out


def infer(pages: list[str]) -> dict:
    """A host's wrapper from some of its pages: path of the article, and the expression."""
    whole, seen = None, 0
    for page in dict.fromkeys(pages):
        found = page_items(page)
        if found is not None and _weight(found):
            whole, seen = found if whole is None else align(whole, found, True), seen + 1
    if whole is None:
        return {"path": None, "expression": ""}
    # one page has no slots: it is read by itself, as a page without a wrapper is
    return {"path": article_path(whole) if seen > 1 else None, "expression": expression(whole)}


class Outline:
    """A page's elements in the order in which they begin: key, children, whether aside, and weight (the characters of texts that
    are neither aside nor linked) of each. The page itself is 0."""

    def __init__(self, page: str, lenient: int = 0):
        self.keys, self.kids, self.asides, self.weights, outer = [""], [[]], [False], [0], [-1]
        stack, events = [0], Events(page, lenient)
        for kind, value in events:
            if kind == "open":
                del stack[len(events.tags) :]
                self.kids[stack[-1]].append(len(self.keys))
                outer.append(stack[-1])
                stack.append(len(self.keys))
                self.keys.append(events.keys[-1])
                self.kids.append([])
                self.asides.append(events.asides[-1])
                self.weights.append(0)
            elif kind == "text" and not (events.asides and events.asides[-1]) and not events.places.get("a") and (text := _clean(value)):
                del stack[len(events.tags) + 1 :]
                self.weights[stack[-1]] += len(text)
        for i in range(len(outer) - 1, 0, -1):
            if not self.asides[i] or self.asides[outer[i]]:
                self.weights[outer[i]] += self.weights[i]

    def _repeats(self, kids: list[int], i: int) -> bool:
        """Whether the i-th of these siblings is one of a run of elements that are alike."""
        a = {self.keys[k] for k in self.kids[kids[i]]}
        for j in (i - 1, i + 1):
            if 0 <= j < len(kids) and self.keys[kids[j]] == self.keys[kids[i]]:
                b = {self.keys[k] for k in self.kids[kids[j]]}
                if self.keys[kids[i]] not in INNER or not a or not b or not a.isdisjoint(b):
                    return True
        return False

    def own_article(self) -> int:
        """The element that holds the article of a page that no wrapper fits: the heaviest that says so, or else inwards from the
        page as long as one child of a kind that can hold an article holds most of the text."""
        named = [i for i, k in enumerate(self.keys) if k.split(".")[0] in ("article", "main") and not self.asides[i]]
        at = max(named, key=lambda i: self.weights[i], default=0)
        at = at if self.weights[at] else 0
        while self.weights[at] and self.keys[at].split(".")[0] != "article":
            kids = self.kids[at]
            i = max((i for i in range(len(kids))), key=lambda i: self.weights[kids[i]], default=None)
            if i is None or self.weights[kids[i]] < INWARD * self.weights[at] or self.keys[kids[i]].split(".")[0] not in INNER or self._repeats(kids, i):
                break
            at = kids[i]
        return at

    def at(self, path: list[list]) -> set[int]:
        """The elements at path. Of several children with a key, that one which holds what the path's holds most of all; all, if
        the wrapper knows only one."""
        found = {0}
        for key, *known in path:
            found = {kid for element in found for kid in self.chosen([k for k in self.kids[element] if self.keys[k] == key], *known)}
        return found

    def chosen(self, kids: list[int], held: list[list[str]] = (), which: int = 0) -> list[int]:
        if not held or not kids:
            return kids
        if len(kids) == len(held):
            return [kids[which]]

        def likeness(kid: int, i: int) -> float:
            own = {self.keys[k] for k in self.kids[kid]}
            return len(own.intersection(held[i])) / max(1, len(own.union(held[i])))

        mine = [k for k in kids if max(range(len(held)), key=lambda i: (likeness(k, i), i == which)) == which]
        return [max(mine, key=lambda k: likeness(k, which))] if mine else []


def blocks_of(page: str, wanted: set[int], lenient: int = 0) -> list[str]:
    """Blocks of these elements, in page order."""
    blocks: list[str] = []
    held: list[str] = []
    # how many elements are open, and how many of them up to the outermost one that is wanted
    begun, inside = 0, 0 if 0 in wanted else None
    events = Events(page, lenient)

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(text)

    for kind, value in events:
        begun += kind == "open"
        if inside is not None and len(events.tags) < inside:
            inside = None
        if kind == "open" and begun in wanted and (inside is None or len(events.tags) <= inside):
            inside = len(events.tags)
        if kind == "text":
            if inside is not None and not (events.asides and events.asides[-1]):
                held.append(html.unescape(value))
        elif value in BLOCK or value in ("hr",):
            flush()
        elif value == "br":
            held.append(" ")
    flush()
    return blocks


def _read(page: str, wrapper: dict | None, lenient: int) -> list[str]:
    outline = Outline(page, lenient)
    wanted = outline.at(wrapper["path"]) if wrapper and wrapper["path"] else set()
    blocks = blocks_of(page, wanted, lenient) if wanted else []
    return blocks or blocks_of(page, {outline.own_article()}, lenient)


def main_text(page: str | None, wrapper: dict | None) -> str:
    """The article of a page, its blocks joined by empty lines: by the host's wrapper, or by the page's own weights where that
    doesn't fit. Where that leaves less than LITTLE of what a form or object holds, these are transparent; where it leaves nothing,
    names of classes say nothing."""
    page = page or ""
    blocks = _read(page, wrapper, 0)
    if CONTAINER.search(page):
        more = _read(page, None, 1)
        if sum(map(len, blocks)) < LITTLE * sum(map(len, more)):
            blocks = more
    if not blocks and page:
        blocks = _read(page, None, 2)
    return "\n\n".join(blocks)


def host(url: Column) -> Column:
    """The URL's host in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) for each host of pages (page_id, url, html), from SAMPLE_PAGES of its pages at most, those with the smallest hashes."""
    keyed = pages.select(host(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)).alias("h"), "html").where("html is not null")
    large = staged(keyed.groupBy("host").count().where(F.col("count") > 8 * SAMPLE_PAGES), "hosts")
    if large.count() <= BROADCAST_HOSTS:  # else every page goes to its host's task, which keeps as few
        keyed = keyed.join(F.broadcast(large), "host", "left").where(F.col("h") < (1 << 40) * F.coalesce(8 * SAMPLE_PAGES / F.col("count"), F.lit(1.0)))
    rank = Window.partitionBy("host").orderBy("h", F.xxhash64("html"))
    drawn = keyed.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= SAMPLE_PAGES).select("host", "h", "html")

    def inferred(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        found = infer(rows.sort_by([("h", "ascending"), ("html", "ascending")])["html"].to_pylist())
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(found)]})

    return drawn.groupBy("host").applyInArrow(inferred, "host string, wrapper string")


def small(wrappers: DataFrame) -> DataFrame:
    """wrappers, to be broadcast if they are few and short."""
    size = wrappers.agg(F.count("*"), F.sum(F.length("wrapper"))).first()
    return F.broadcast(wrappers) if size[0] <= BROADCAST_HOSTS and (size[1] or 0) <= 32 << 20 else wrappers


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html): the article's text.

    Null or empty html, and pages without an article, have an empty text. A null url belongs to the host ''. Repeated rows
    give a row each, and equal pages of a host equal texts; no page is cut short, however long or deep, and nothing that
    the article holds is left out but what is marked as something else (DROPPED, _aside). Other columns are not read. An
    empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    path = F.concat(F.lit('{"path": '), F.coalesce(F.get_json_object("wrapper", "$.path"), F.lit("null")), F.lit("}"))
    wrappers = small(staged(host_wrappers(pages), "wrappers").select("host", path.alias("wrapper")))
    read = keyed.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist()):
                if wrapper not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[wrapper] = json.loads(wrapper)
                texts.append(main_text(page.as_py(), known[wrapper]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return read.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
