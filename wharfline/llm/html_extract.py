"""Main text by site style trees.

Pages of one host are merged into a style tree. An element node has one style
for each sequence of child elements that it shows on some page, and a style has
one element node for each child in it; elements without text are left out, and
text beside elements is an element of its own. Over the m pages that have a node
with l styles, of which style s is shown on m_s,

* presentation importance is the entropy, to base m, of the styles;
* content importance of a style that holds text alone is 1 minus the mean
  entropy, to base m_s, of its distinct texts: a text on c pages has entropy
  log c / log m_s, so what returns on every page is worth 0;
* importance is (1 - DECAY^l) times the presentation's plus DECAY^l times the
  mean, by m_s / m, of the styles' importance, which is their content's or the
  mean of their children's. What a single page has is worth 1.

Importance is then averaged with that of the element around, which counts as
``DOUBT`` pages (around the page all is worth 1), and mixed with what an
element's marks say, its tag, names and role (``_VIEW``): those of an article or
of prose weigh 3/4; those of menus, headers, footers, sidebars, notices, adverts
and readers' comments weigh a half against; what lies outside of a marked
article weighs 1/4 against. Marks decide nothing alone: extraction removes the
branches that the tree names and no others.

A branch is worth as much as the best element in it, but no more than its marks
leave it. It is removed if that is below ``LEAST`` of the best branch beside it,
so something always stays, and a container stays for what it holds. A page with
no text but that marked as noise has no main text. Forms, scripts, styles and
hidden elements are never text.

The tree is stored as rows (style, place in it, own style or text): merging a
host's pages is a sum, so a host with a third of all pages is spread over all
tasks. Only styles of two pages or more are summed up; what one page has alone
is judged by itself. Importance is a linear recurrence and is solved by doubling
the distance that values are passed, in as many rounds as the depth has binary
digits.

Defined results: null or empty html gives the empty text; a null or odd url
belongs to the host ''; repeated rows each get their own result and count as
one page; long pages and any depth are taken whole, in linear time; of branches
worth the same none is removed for the other; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.session import materialise, ship

DECAY = 0.5
DOUBT = 8
LEAST = 0.78
#: Removable nodes that are sent to all tasks; beyond, each page fetches its own.
SENT_NODES = 500_000
#: Nodes of the merged trees that the driver judges by itself; beyond, joins do.
HERE_NODES = 1 << 20

# HTML's element classes, and the names by which elements call themselves boilerplate.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_NEVER = frozenset("form script style noscript template button select option input textarea iframe svg canvas object embed dialog head title fieldset".split())
_NOISE = frozenset("nav footer aside menu".split())
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPE = frozenset("html body article main section div aside nav footer header form blockquote table td th li ul ol dl figure details fieldset button".split())
_SELF = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription widget widgets toolbar pagination pager login signup search searchbox form outbrain taboola responses feedback talkback alert alerts announcement announcements disclaimer paywall popover legal imprint submenu dropdown teaser teasers trending popular rail".split()
)
_INSIDE = re.compile(r"sidebar|comment|advert|cookie|footer|navbar|newsletter|breadcrumb|sponsor")
_ROOM = frozenset("wrap wrapper layout page site".split())
_DISCUSSION = frozenset("comment comments commentlist reply replies responses related ad advert sponsored promo teaser".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_VALUE = re.compile(r"""=\s*(["'])|>""")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: A whole tag, if all of its quoted values end.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=(?!\s*["']))*+)>""")
_ATTR = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")

_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WITH = re.compile(r"\b(?:has|with|no|without|not)[-_][a-z]+")

#: What marks say an element is. NAMED is noise by its names alone: an article in it still counts.
NOISE, NEUTRAL, ARTICLE, NAMED, PROSE, OUTSIDE, NEVER = range(7)
#: For each kind but NEVER the weight and the worth of its marks beside the tree's importance.
_VIEW = ((0.5, 0.0), (0.0, 0.0), (0.75, 1.0), (0.5, 0.0), (0.75, 1.0), (0.25, 0.0))
#: What a kind is worth where importance is 1.
_MOST = tuple(1 - w + w * v for w, v in _VIEW)


def _kind(tag: str, attrs: str, outer: int) -> tuple[int, str]:
    """What an element is by its tag, attributes and surroundings, and its class names."""
    if outer == NEVER or tag in _NEVER:
        return NEVER, ""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
    label = _DIGITS.sub("0", " ".join(sorted(found.get("class", "").lower().split())))
    if "hidden" in found or "display:none" in found.get("style", "").lower().replace(" ", ""):
        return NEVER, label
    if outer == NOISE or tag in _NOISE:
        return NOISE, label
    called = _WITH.sub(" ", _CASE.sub(" ", found.get("class", "") + " " + found.get("id", "")).lower())
    names = set(_WORD.findall(called))
    role = found.get("role", "").lower()
    if tag in ("article", "main") or role == "main" or "articlebody" in found.get("itemprop", "").lower():
        return (NOISE if names & _DISCUSSION else ARTICLE), label
    if tag in ("html", "body"):
        return outer, label
    if tag == "header":
        return (outer if outer == ARTICLE else NOISE), label
    bad = names & _NAMES | {n for n in names if _INSIDE.search(n)}
    if bad == {"header"} and (outer == ARTICLE or names & {"article", "post", "entry", "story"}) or bad <= {"header", "sidebar"} and names & _ROOM:
        bad = set()
    if role in _ROLES:
        return NOISE, label
    if bad or outer == NAMED:
        return (NOISE if bad & _DISCUSSION else NAMED), label
    return (PROSE if outer == NEUTRAL and tag in _PROSE else outer), label


def _unmarked(tag: str, attrs: str, outer: int) -> tuple[int, str]:
    """The same where tags and names tell nothing but what is never text."""
    kind, label = _kind(tag, attrs, outer)
    return (NEVER if kind == NEVER else NEUTRAL), label


def _remembering(kind_of: Callable) -> Callable:
    """The same function, with the answers for short attributes kept."""
    known: dict[tuple, tuple[int, str]] = {}

    def kind(tag: str, attrs: str, outer: int) -> tuple[int, str]:
        if len(attrs) > 128:
            return kind_of(tag, attrs, outer)
        found = known.get((tag, attrs, outer))
        if found is None:
            if len(known) > 20_000:
                known.clear()
            found = known[tag, attrs, outer] = kind_of(tag, attrs, outer)
        return found

    return kind


def tags(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, '/' or '', tag, attributes, end) of each tag, and the last text with no tag.

    One scan forward. If a quoted value never ends, quotes mean nothing from
    there on; of a tag that never ends the text is dropped, as of a comment.
    ``send`` a place to go on from there.
    """
    at = begin = 0
    quotes, last = True, page.rfind(">")
    while (lt := page.find("<", at)) >= 0:
        m = _TAG.match(page, lt) if quotes and lt < last else None
        if m:
            sent = yield page[begin:lt], m[1], m[2].lower(), m[3], m.end()
            at = begin = m.end() if sent is None else sent
            continue
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            gt = end + 2 if end >= 0 else len(page)
            name = None
        else:
            slash = page.startswith("/", lt + 1)
            name = _NAME.match(page, lt + 1 + slash)
            if not name and not page.startswith(("!", "?"), lt + 1):
                at = lt + 1
                continue
            if lt > last:
                break
            gt = page.find(">", lt) if not name or not quotes else -1
            here = name.end() if name else lt
            while gt < 0:
                m = _VALUE.search(page, here)
                if m and not m[1]:
                    gt = m.start()
                    break
                here = page.find(m[1], m.end()) + 1 if m else 0
                if not here:
                    quotes, gt = False, page.find(">", lt)
        sent = yield page[begin:lt], "/" if name and slash else "", name[0].lower() if name else "", page[name.end() : gt] if name else "", gt + 1
        at = begin = gt + 1 if sent is None else sent
    rest = page[begin:]
    cut = rest.rfind("<")
    if cut >= 0 and re.match(r"[A-Za-z/!]", rest[cut + 1 : cut + 2]):
        rest = rest[:cut]
    yield rest, "", "", "", len(page)


class Page:
    """The elements of a page that hold text, as a tree. Element 0 is the page.

    ``kids`` lists an element's children, none where it holds text alone (a text
    beside elements, or of other marks, is an element of its own); ``text`` and
    ``inline`` (the inline tags in it) are those of such elements; ``most`` is
    what an element's marks leave it at most.
    """

    def __init__(self, page: str, kind_of: Callable = _kind) -> None:
        self.label, self.kind, self.kids, self.text, self.inline = [""], [NEUTRAL], [[]], [""], [""]
        self._parse(page, kind_of)
        self._tidy()

    def _new(self, parent: int, label: str, kind: int) -> int:
        self.label.append(label)
        self.kind.append(kind)
        self.kids.append([])
        self.text.append("")
        self.inline.append("")
        self.kids[parent].append(len(self.label) - 1)
        return len(self.label) - 1

    def _parse(self, page: str, kind_of: Callable) -> None:
        stack = [("", NEUTRAL, 0)]  # tag, kind, element of the text
        opened: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack each tag is
        text: list[str] = []
        around: list[str] = []

        def flush() -> None:
            if text:
                whole = " ".join("".join(text).split())
                if whole:
                    self.kids[stack[-1][2]].append((stack[-1][1], " ".join(around), whole))
                text.clear()
            if around:
                around.clear()

        def close(depth: int) -> None:
            while len(stack) > depth:
                tag, kind, element = stack[-1]
                if element != stack[-2][2] or kind != stack[-2][1]:
                    flush()
                stack.pop()
                opened[tag].pop()

        def close_last(tag: str, scope: frozenset[str]) -> None:
            """Close the innermost ``tag``, unless an element of ``scope`` is inside it."""
            if (at := opened.get(tag)) and all(at[-1] > there[-1] for s in scope if (there := opened.get(s))):
                close(at[-1])

        scan, sent = tags(page), None
        while True:
            try:
                raw, slash, tag, attrs, end = scan.send(sent)
            except StopIteration:
                break
            sent = None
            if raw and stack[-1][1] != NEVER:
                text.append(html.unescape(raw) if "&" in raw else raw)
            if not tag:
                continue
            if slash:
                depth = opened[tag][-1] if opened[tag] else 0
                if depth:
                    close(depth)
                elif tag not in _INLINE:
                    flush()
                continue
            if tag in _RAW:
                flush()
                shut = re.compile(rf"</{tag}[\s/>]", re.I).search(page, end)
                gt = page.find(">", shut.start()) if shut else -1
                sent = gt + 1 if gt >= 0 else len(page)
                continue
            if tag not in _INLINE:
                flush()
            if tag in _VOID:
                if tag == "br":
                    text.append(" ")
                continue
            if tag in _CLOSES_P:
                close_last("p", _SCOPE)
            elif tag in _SELF:
                close_last(tag, _SELF[tag])
            outer = stack[-1][1]
            kind, label = kind_of(tag, attrs, outer)
            if kind != outer:
                flush()
            element = stack[-1][2]
            if kind == NEVER:
                pass
            elif tag not in _INLINE or kind != outer:
                element = self._new(element, f"{tag}.{label}" if label else tag, kind)
            else:
                around.append(tag)
            opened[tag].append(len(stack))
            stack.append((tag, kind, element))
        flush()

    def _tidy(self) -> None:
        """Gives texts their elements, leaves out what holds none, and tells what lies outside of the article."""
        n = len(self.label)
        holds, marked = [False] * n, [False] * n
        for i in range(n - 1, -1, -1):  # children come after their parents
            kids = [k for k in self.kids[i] if type(k) is tuple or holds[k]]
            holds[i] = bool(kids)
            if len(kids) == 1 and type(kids[0]) is tuple and kids[0][0] == self.kind[i]:
                (kind, self.inline[i], self.text[i]), kids = kids[0], []
                marked[i] = kind == ARTICLE
            for at, k in enumerate(kids):
                if type(k) is tuple:
                    kids[at] = len(self.label)
                    self.label.append("#")
                    self.kids.append([])
                    self.kind.append(k[0])
                    self.inline.append(k[1])
                    self.text.append(k[2])
                    marked.append(k[0] == ARTICLE)
                marked[i] = marked[i] or marked[kids[at]]
            self.kids[i] = kids
        if marked[0]:
            self.kind = [OUTSIDE if k in (NEUTRAL, PROSE) and not a else k for k, a in zip(self.kind, marked, strict=True)]
        self.most = [_MOST[k] if t else 0.0 for k, t in zip(self.kind, self.text, strict=True)]
        for i in range(n - 1, -1, -1):
            if self.kids[i]:
                self.most[i] = max([self.most[k] for k in self.kids[i]])

    def has_main_text(self) -> bool:
        return self.most[0] > _MOST[NOISE]

    def nodes(self, host: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(element, style it is in, place, own style, or the page's, its node); parents first."""
        todo = [(0, _long(host, "page"))]
        while todo:
            i, node = todo.pop()
            if not self.kids[i]:
                continue
            style = self._style(i, node)
            for j, k in enumerate(self.kids[i], 1):
                own = style ^ (j * _STEP)
                yield k, style, j, self._style(k, own) if self.kids[k] else _long(self.inline[k]), own
                todo.append((k, own))

    def _style(self, i: int, node: int) -> int:
        return _long(str(node), *[f"{self.kind[k]}{self.label[k]}" for k in self.kids[i]])


_STEP = 0x9E3779B9


def host_of(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _long(*parts: str) -> int:
    n = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


def alone(page: Page, host: str) -> set[int]:
    """The nodes that are removed if no other page has them: importance is 1 all over."""
    gone, best = set(), {}
    if page.has_main_text():
        rows = [(style, node, page.most[k]) for k, style, _, _, node in page.nodes(host)]
        for style, _, most in rows:
            best[style] = max(most, best.get(style, 0.0))
        gone = {node for style, node, most in rows if most < LEAST * best[style]}
    return gone


def extract(page: Page, host: str, gone: set[int]) -> str:
    """The page's text without its removable branches."""
    if not page.has_main_text():
        return ""
    out, todo = [], [(0, _long(host, "page"))]
    while todo:
        i, node = todo.pop()
        if not page.kids[i]:
            out.append(page.text[i])
            continue
        style = page._style(i, node)
        for j in range(len(page.kids[i]), 0, -1):
            own = style ^ (j * _STEP)
            if own not in gone:
                todo.append((page.kids[i][j - 1], own))
    return " ".join(out)


_SEEN = ("key", "parent", "place", "n", "style", "text", "kind", "most", "gone")
_SEEN_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.float32(), pa.bool_())
_NODE = f"parent ^ (place * {_STEP}L)"


def rows_of(key: int, url: str | None, source: str | None, kind_of: Callable = _kind) -> list[tuple]:
    """The page's elements: the style each is in, its place there of how many, its own style
    or hash of its text, its marks, and whether the page would remove it by itself."""
    page, host = Page(source or "", kind_of), host_of(url)
    if not page.has_main_text():
        return []
    rows, sizes, best = list(page.nodes(host)), {}, {}
    for k, style, j, _, _ in rows:
        sizes[style] = j
        best[style] = max(page.most[k], best.get(style, 0.0))
    return [(key, style, j, sizes[style], own, None if page.kids[k] else _long(page.text[k]), page.kind[k], page.most[k], page.most[k] < LEAST * best[style]) for k, style, j, own, _ in rows]


def merged(seen: DataFrame) -> DataFrame:
    """The nodes of at least two pages, from weighted rows as of ``rows_of``.

    (node, parent, up, w, m, own, kind, most): ``up`` is the node around it, if
    that is one of these, ``own`` what isn't its children's part of importance,
    and ``w`` its share of the importance of ``up``.
    """
    ln = lambda c: F.log(F.greatest(c, F.lit(1.0)))
    pages = F.sum("weight")
    by_text = seen.groupBy(F.expr(_NODE).alias("node"), "parent", "n", "style", "text").agg(pages.alias("c"), F.max("kind").alias("kind"), F.max("most").alias("most"))
    by_style = by_text.groupBy("node", "parent", "n", "style", F.col("text").isNull().alias("inner")).agg(F.sum("c").alias("ms"), F.avg(ln("c")).alias("spread"), F.max("kind").alias("kind"), F.max("most").alias("most"))
    by_style = materialise(by_style, "tree-styles")  # read twice below
    ms, m = F.col("ms"), F.col("m")
    worth = F.when(ms < 1.5, 1.0).when(F.col("inner"), 0.0).otherwise(1 - F.col("spread") / F.log(ms))
    by_node = by_style.groupBy("node", "parent", "n").agg(
        F.sum("ms").alias("m"), F.count("*").alias("l"), F.sum(ms * ln(ms)).alias("styled"), F.sum(ms * worth).alias("worth"), F.max("kind").alias("kind"), F.max("most").cast("double").alias("most")
    )
    fade = F.pow(F.lit(DECAY), F.col("l"))
    shown = F.greatest(F.lit(0.0), F.log(m) - F.col("styled") / m) / F.log(m)
    nodes = by_node.select("node", "parent", "n", "m", "kind", "most", fade.alias("fade"), ((1 - fade) * shown + fade * F.col("worth") / m).alias("own"))
    styles = by_style.where("inner and ms > 1.5").select("node", F.col("style").alias("parent"), "ms")
    ups = styles.join(nodes.select("node", "m", "fade"), "node").select("parent", F.col("node").alias("up"), (F.col("fade") * F.col("ms") / F.col("m")).alias("share"))
    return nodes.join(ups, "parent", "left").select("node", "parent", "up", (F.col("share") / F.col("n")).alias("w"), "m", "own", "kind", "most")


def _doubled(nodes: DataFrame) -> list[DataFrame]:
    """(node, up, w, d) of each round: ``up`` lies 2^round above ``node``."""
    rounds, step = [], materialise(nodes.where("up is not null").select("node", "up", "w", "d"), "tree-jumps")
    while not step.isEmpty():
        rounds.append(step)
        far = step.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("w").alias("w2"), F.col("d").alias("d2"))
        step = materialise(step.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("w") * F.col("w2")).alias("w"), (F.col("d") * F.col("d2")).alias("d")), "tree-jumps")
    return rounds


def judged(tree: DataFrame) -> DataFrame:
    """(node, parent, importance, worth) of all nodes of ``merged``."""
    tree = tree.withColumn("d", DOUBT / (F.col("m") + DOUBT))
    jumps = _doubled(tree)
    held = tree.select("node", F.col("own").alias("x"))
    for step in jumps:  # up: what lies below adds to a node
        below = step.join(held, "node").groupBy(F.col("up").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("more"))
        held = materialise(held.join(below, "node", "left").select("node", (F.col("x") + F.coalesce("more", F.lit(0.0))).alias("x")), "tree-importance")
    known = tree.join(held, "node")
    last = F.when(F.col("up").isNull(), F.col("d")).otherwise(0.0)
    value = materialise(known.select("node", (F.col("x") * (1 - F.col("d")) + last).alias("v")), "tree-value")
    for step in jumps:  # down: what lies around stands for some pages
        around = step.select("node", "up", "d").join(value.select(F.col("node").alias("up"), F.col("v").alias("far")), "up").select("node", (F.col("d") * F.col("far")).alias("more"))
        value = materialise(value.join(around, "node", "left").select("node", (F.col("v") + F.coalesce("more", F.lit(0.0))).alias("v")), "tree-value")
    view = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _VIEW]), F.col("kind") + 1)
    best = materialise(known.join(value, "node").select("node", F.least("most", (1 - view(0)) * F.col("v") + view(0) * view(1)).alias("b")), "tree-worth")
    for step in jumps:  # up: a branch is worth its best element
        below = step.join(best, "node").groupBy(F.col("up").alias("node")).agg(F.max("b").alias("more"))
        best = materialise(best.join(below, "node", "left").select("node", F.greatest("b", F.coalesce("more", F.lit(0.0))).alias("b")), "tree-worth")
    return known.select("node", "parent", F.col("x").alias("importance")).join(best.withColumnRenamed("b", "worth"), "node")


def judged_here(tree: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``judged`` of a tree of checked size: node, importance and worth."""
    order = np.argsort(tree.column("node").to_numpy(), kind="stable")
    node, m, own, most = (tree.column(c).to_numpy()[order] for c in ("node", "m", "own", "most"))
    low = tree.column("up").is_valid().to_numpy()[order].nonzero()[0]
    up = np.searchsorted(node, tree.column("up").drop_null().to_numpy()[np.argsort(np.argsort(order)[tree.column("up").is_valid().to_numpy()], kind="stable")])
    d = DOUBT / (m + DOUBT)
    step, rounds = (low, up, tree.column("w").to_numpy()[order][low], d[low]), []
    while step[0].size:
        rounds.append(step)
        at, to, w, f = step
        back = np.full(node.size, -1)
        back[at] = np.arange(at.size)
        k = back[to]
        on = k >= 0
        step = at[on], to[k[on]], (w[on] * w[k[on]]), f[on] * f[k[on]]
    x = own.copy()
    for at, to, w, _ in rounds:
        x += np.bincount(to, w * x[at], node.size)
    top = np.ones(node.size, bool)
    top[low] = False
    v = x * (1 - d) + np.where(top, d, 0.0)
    for at, to, _, f in rounds:
        more = f * v[to]
        v[at] += more
    weight, says = np.array(_VIEW)[tree.column("kind").to_numpy()[order]].T
    best = np.minimum(most, (1 - weight) * v + weight * says)
    for at, to, _, _ in rounds:
        below = best[at]
        np.maximum.at(best, to, below)
    return node, x, best


def removable_nodes(seen: DataFrame, repeated: DataFrame, here_nodes: int = HERE_NODES) -> DataFrame:
    """The distinct nodes to remove, from rows as of ``rows_of``; ``repeated`` has (key, times).

    A tree of up to ``here_nodes`` nodes is judged on the driver, a larger one in
    joins, to the same result.
    """
    weighted = seen.join(repeated, "key", "left").withColumn("weight", 1 / F.coalesce("times", F.lit(1)))
    shared = weighted.where("place = 1").groupBy("parent").agg(F.sum("weight").alias("pages")).where("pages > 1.5").select("parent")
    shared = materialise(shared, "tree-shared")
    tree = materialise(merged(weighted.join(shared, "parent", "left_semi")), "tree")
    if tree.count() <= here_nodes:
        rows = tree.toArrow()
        node, importance, worth = judged_here(rows)
        parent = rows.column("parent").to_numpy()[np.argsort(rows.column("node").to_numpy(), kind="stable")]
        found = seen.sparkSession.createDataFrame(pa.table({"node": node, "parent": parent, "importance": importance, "worth": worth}))
    else:
        found = materialise(judged(tree), "tree-judged")
    top = found.groupBy("parent").agg(F.max("worth").alias("best"))
    gone = found.join(top, "parent").where(F.col("worth") < LEAST * F.col("best")).select("node")
    single = seen.where("gone").join(shared, "parent", "left_anti").select(F.expr(_NODE).alias("node"))
    return gone.union(single.distinct())


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", marks: bool = True, sent_nodes: int = SENT_NODES, here_nodes: int = HERE_NODES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Without ``marks`` neither tags nor names tell what is an article or noise.
    """
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    keyed = named.withColumn("key", F.xxhash64("url", "html"))
    spark, marked, kind = pages.sparkSession, _kind if marks else _unmarked, pages.schema[page_id].dataType.simpleString()
    types = "key long, parent long, place int, n int, style long, text long, kind byte, most float, gone boolean"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        kind_of = _remembering(marked)

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(_SEEN)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SEEN_KINDS, strict=True)], names=list(_SEEN))

        for b in batches:
            for k, u, h in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                rows += rows_of(k, u, h, kind_of)
                if len(rows) > 10_000:
                    yield batch()
        yield batch()

    seen = materialise(keyed.select("key", "url", "html").mapInArrow(learn, types), "style-tree")
    repeated = materialise(keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "tree-repeated")
    gone = materialise(removable_nodes(seen, repeated, here_nodes), "removable")
    if gone.count() <= sent_nodes:
        sent = ship(spark, frozenset(gone.toArrow().column("node").to_pylist()))  # a checked size
        ready = keyed.select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("gone"))
    else:
        sent = None
        fetched = seen.select("key", F.expr(_NODE).alias("node")).distinct().join(gone, "node").groupBy("key").agg(F.collect_list("node").alias("gone"))
        ready = keyed.join(fetched, "key", "left").select("page_id", "url", "html", "gone")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind_of = pickle.loads(sent.value) if sent else None, _remembering(marked)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                own = [None] * b.num_rows if known is not None else b.column("gone").to_pylist()
                texts = [extract(Page(h or "", kind_of), host_of(u), known if known is not None else set(g or ())) for u, h, g in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), own, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return ready.mapInArrow(take, f"page_id {kind}, url string, text string, n_chars long")
