"""Main text of web pages by composite text density.

The page is parsed into a tree of blocks; scripts, menus, forms, adverts,
notices, page headers and footers, sidebars and reader comments, known by
their tag, role or the last word of a class or id, are left out of it, unless
they hold an article, a main or most of the page's text.  Every remaining node has a
density: its characters per tag, scaled down by the share of link characters
and link tags in it against the page's.  The node whose children's densities
sum highest is the centre of the content.  The article or main around it, or
on a page without these the highest block around it that is mainly prose, is
kept whole, headings and short paragraphs included; beside an article or
outside any, blocks of three links or more that are mainly link text are left
out.  Of what stands outside that block, the least density on the path from the
body to the centre is the threshold that a neighbouring block along that path
has to reach to be read with it, if it is neither link text nor shorter than a
sentence.

One pass over the rows, no shuffle.  Defined cases: null or empty html and
pages without content give an empty text; unclosed and stray tags are closed
as browsers do for blocks; broken or unknown declarations are comments; of
equally dense nodes the first of the page is the centre; repeated rows are read each; other columns are
ignored.
"""
from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
DROPPED = set(
    "script style noscript template iframe object embed svg canvas audio video head title button select textarea input option".split()
)
ASIDE = set("nav footer aside form dialog menu header".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASSES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget share sharing "
    "social related recommended comment comments disqus respond replies newsletter subscribe signup login search pagination "
    "skip masthead topbar".split()
)
OTHERS = set("sponsor sponsored promo promotion related recommended comment comments disqus respond replies".split())  # may hold articles of their own
# Words of class names that say where a part stands, and that another part is meant.
PLACES = set(
    "area bar block bottom box button buttons col column container content form footer header icon icons inner item items left link links "
    "list main outer primary right row secondary section slot title top unit wrap wrapper".split()
) - CLASSES
MODIFIERS = set("has have no not non with without show shows hide hides is".split())
CLOSES_P = set(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SAME_CLOSED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKS = ("article", "main")
SCOPES = set("ul ol dl table tr article section div main body aside nav".split())

_COMMENT_END = re.compile("--!?>")
_TAG = re.compile("<[A-Za-z/!?]")


class Tree(HTMLParser):
    """Blocks as parallel lists; node 0 is the page.  ``text`` holds (node,
    string, in a link) in page order; a string of None breaks the block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.links, self.doubt = [-1], ["body"], [0], [""]
        self.text: list[tuple[int, str | None, bool]] = []
        self.open: list[tuple[str, int]] = [("body", 0)]  # (tag, node), inline tags with their block's node
        self.places: dict[str, list[int]] = {}  # of every tag in open, but for the body
        self.skip: list[str] = []
        self.in_link = 0

    def _left_out(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """``all``: left out whatever it holds; ``tag``, ``name`` or ``other``:
        left out by its tag, its name, or a name of other people's articles,
        unless ``prune`` finds content in it; else empty."""
        if tag in DROPPED:
            return "all"
        if tag in ("body", "html"):
            return ""
        a = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
            return "all"
        names = f"{a.get('class', '')} {a.get('id', '')}".split()
        if tag in ("article", "main"):
            return "other" if any(x in ("comment", "comments", "sidebar", "ad", "advert") for x in names) else "name" if a.get("role") in ROLES else ""
        words = {w for x in names if (w := boilerplate(x))}
        if tag in ASIDE - {"form"} and (tag != "header" or self._nearest(MARKS) < 0):
            return "tag"
        if words & OTHERS:
            return "other"
        return "name" if words or tag == "form" or a.get("role") in ROLES else ""

    def _nearest(self, tags) -> int:
        return max((x[-1] for t in tags if (x := self.places.get(t))), default=-1)

    def parse_comment(self, i, report=1):
        if not _COMMENT_END.search(self.rawdata, i + 2):
            return len(self.rawdata)  # a comment without end holds the rest of the page
        return super().parse_comment(i, report)

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # an unknown or broken marked section is a comment, as in browsers
            return self.parse_bogus_comment(i)

    def _pop_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.places[tag].pop()
            if tag == "a":
                self.in_link = max(0, self.in_link - 1)
            elif tag not in INLINE:
                self.text.append((0, None, False))
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag not in VOID and tag == self.skip[0]:
                self.skip.append(tag)
            return
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P or tag in SAME_CLOSED:
            gone = SAME_CLOSED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            at = self._nearest(gone)
            if at >= max(1, self._nearest(SCOPES)):
                self._pop_to(at)
        if tag in VOID:
            if tag in ("br", "hr"):
                self.text.append((0, None, False))
            return
        doubt = self._left_out(tag, attrs)
        if tag not in INLINE:
            self.text.append((0, None, False))
        if doubt == "all":
            self.skip = [tag]
            return
        node = self.open[-1][1]
        if tag not in INLINE or doubt:
            self.parent.append(node)
            self.tag.append(tag)
            self.links.append(0)
            self.doubt.append(doubt)
            node = len(self.tag) - 1
        if tag == "a":
            self.in_link += 1
            self.links[node] += 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.skip and self.skip[-1] == tag and len(self.skip) == 1 and tag not in ("script", "style"):
            self.skip = []
        elif not self.skip and self.doubt[self.open[-1][1]] and self.open[-1] == (tag, len(self.tag) - 1):
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            elif tag in ("body", "html"):
                self.skip = []
            return
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])

    def handle_data(self, data):
        if not self.skip:
            self.text.append((self.open[-1][1], data, self.in_link > 0))


    def prune(self) -> None:
        """Leave out the nodes in doubt, with what is below them, except those
        that hold a main; an article (by their tag or a name in OTHERS: one of
        most of the page's text outside links); or, known by their name, most
        of that text where no article or main of a quarter of theirs stands
        elsewhere (names in OTHERS: nor a ninth outside all nodes in doubt)."""
        n = len(self.tag)
        if not any(self.doubt):
            return
        chars, mains, marked, longest = [0] * n, [0] * n, [0] * n, [0] * n
        for node, s, linked in self.text:
            if s is not None and not linked:
                chars[node] += len("".join(s.split()))
        inside, other, left_out, sure = [False] * n, [False] * n, [False] * n, [True] * n
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = inside[p] or self.tag[p] in ("article", "main") and not self.doubt[p]
            other[i] = other[p] or self.doubt[p] in ("tag", "other")
            sure[i] = sure[p] and not self.doubt[i]
        plain = sum(c for c, x in zip(chars, sure) if x)
        for i in range(n - 1, 0, -1):
            if self.tag[i] in ("article", "main") and not self.doubt[i] and chars[i]:
                mains[i] += self.tag[i] == "main"
                longest[i] = max(longest[i], chars[i] * (self.tag[i] == "article"))
                marked[i] = 0 if other[i] else chars[i]  # of the outermost
            p = self.parent[i]
            chars[p] += chars[i]
            mains[p] += mains[i]
            marked[p] += marked[i]
            longest[p] = max(longest[p], longest[i])
        for i in range(1, n):
            p, kind = self.parent[i], self.doubt[i]
            if left_out[p]:
                left_out[i] = True
            elif kind:
                holds = mains[i] or longest[i] and (kind == "name" or 2 * longest[i] > chars[0])
                elsewhere = marked[0] - (chars[i] if inside[i] and not other[i] else marked[i])
                alone = kind == "name" and inside[i] or 4 * elsewhere < chars[i]
                known = kind == "tag" or kind == "other" and 9 * plain >= chars[i]
                left_out[i] = not (holds or alone and not known and 2 * chars[i] > chars[0])
        number, kept = [0] * n, [i for i in range(n) if not left_out[i]]
        for k, i in enumerate(kept):
            number[i] = k
        self.text = [(number[i], s, linked) for i, s, linked in self.text if not left_out[i]]
        self.parent = [-1 if i == 0 else number[self.parent[i]] for i in kept]
        self.tag, self.links = [self.tag[i] for i in kept], [self.links[i] for i in kept]
        self.doubt = [""] * len(kept)


def boilerplate(name: str) -> str:
    """The word of CLASSES that a class or id is named by, else empty: the
    name itself or its last word, apart from words of place, numbers and BEM
    modifiers; never in names such as has-sidebar."""
    if name in CLASSES:
        return name
    parts = [x for x in re.split(r"[-_]+", name.split("--")[0]) if x]
    if MODIFIERS & set(parts) or not CLASSES & set(parts):
        return ""
    while len(parts) > 1 and (parts[-1] in PLACES or parts[-1].isdigit()):
        parts.pop()
    head = next((x for x in (parts[-1], parts[-1].removesuffix("s")) if x in CLASSES), "")
    if head == "widget" and len(parts) > 1 and not CLASSES & set(parts[:-1]):
        return ""  # page builders name their blocks so
    return head


def _parse(html: str) -> Tree:
    tree = Tree()
    unfinished = _TAG.search(html, html.rfind(">") + 1)  # a tag cut off at the end is no text
    tree.feed(html[: unfinished.start()] if unfinished else html)
    tree.close()
    tree.prune()
    return tree


def densities(tree: Tree) -> tuple[list[float], list[float], list[int], list[int]]:
    """Density, sum of the children's densities, characters and link
    characters of every node."""
    n = len(tree.tag)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [1] * n, list(tree.links)
    for node, s, linked in tree.text:
        if s is not None:
            k = len("".join(s.split()))
            chars[node] += k
            link_chars[node] += k * linked
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        for x in (chars, link_chars, tags, link_tags):
            x[p] += x[i]
    share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if chars[i]:
            c, lc = chars[i], link_chars[i]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            x = c / max(1, lc) * tags[i] / max(1, link_tags[i])
            density[i] = c / tags[i] * math.log(max(x, 1.0) + 1e-9) / max(math.log(base), 1e-3)
    for i in range(1, n):
        total[tree.parent[i]] += density[i]
    return density, total, chars, link_chars


SENTENCE_CHARS = 25
MENU_LINKS = 3
# Names of HTML.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


def _whole(tree: Tree, path: list[int], chars: list[int], link_chars: list[int]) -> set[int]:
    """Nodes of the content around ``path[0]``, the densest node: all of its
    article or main, or of the highest node above it that is mainly prose once
    lists of links beside the path are left out."""
    n = len(tree.tag)
    links, title = list(tree.links), [t == "h1" for t in tree.tag]
    beside: dict[int, list[int]] = {i: [] for i in path}
    on_path = set(path)
    for i in range(n - 1, 0, -1):
        links[tree.parent[i]] += links[i]
        title[tree.parent[i]] |= title[i]
    for i in range(1, n):
        if tree.parent[i] in on_path and i not in on_path:
            beside[tree.parent[i]].append(i)

    def menu(i: int) -> bool:
        return links[i] >= MENU_LINKS and 2 * link_chars[i] > chars[i] and tree.tag[i] not in HEADINGS

    marks = [k for k, i in enumerate(path) if tree.tag[i] in MARKS]
    start = marks[0] if marks else 0  # whole, with its lists of links
    top, c, lc = start, chars[path[start]], link_chars[path[start]]
    for k in range(start + 1, len(path)):
        i = path[k]
        off = [path[k - 1], *(x for x in beside[i] if menu(x))]
        c += chars[i] - sum(chars[x] for x in off)
        lc += link_chars[i] - sum(link_chars[x] for x in off)
        prose = c - lc >= SENTENCE_CHARS and 3 * lc <= c
        if prose and (not marks or k in marks):
            top = k
    climbed = set(path[start + 1 : top + 1])  # their own text, and what stands beside the path
    whole, apart = {path[start]}, set(climbed)
    for i in range(1, n):
        if tree.parent[i] in whole:
            whole.add(i)
        elif tree.parent[i] in apart and i not in on_path:
            if not menu(i):
                whole.add(i)
            elif title[i]:  # a headline among links
                apart.add(i)
    return whole | apart


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = _parse(html)
    density, total, chars, link_chars = densities(tree)
    if not chars[0]:
        return ""
    n = len(tree.tag)
    # a page whose text stands in one leaf, or in no block at all, is that node
    best = max(range(n), key=lambda i: (total[i] if total[i] else density[i] * 0.5 if i == 0 else 0.0, -i))
    kept = [False] * n
    path = [best]
    while path[-1] > 0:
        path.append(tree.parent[path[-1]])
    threshold = min(density[i] for i in path)
    kept[best] = True
    on_path = set(path)
    whole = _whole(tree, path, chars, link_chars)
    for i in range(1, n):
        if kept[tree.parent[i]] and tree.parent[i] not in on_path - {best}:
            kept[i] = True
        elif tree.parent[i] in on_path and i not in on_path and tree.parent[i] != best:
            prose = chars[i] - link_chars[i] >= SENTENCE_CHARS and 3 * link_chars[i] <= chars[i]
            kept[i] = prose and density[i] >= threshold
    out = []
    for node, s, _ in tree.text:
        if s is None:
            out.append(" ")
        elif kept[node] or node in whole or node in on_path and node != 0 or n == 1:
            out.append(s)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for every row."""

    @F.pandas_udf("string")
    def read(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html], dtype=object)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), read(F.col(html_col)).alias("text"))
