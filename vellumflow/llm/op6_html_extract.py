"""Main text of web pages by consensus over the pages of a host.

First pass: the containers of each page are scored by the text below them that is not in links, menus, forms and the like;
the smallest container that leaves no heading and no paragraphs of the article outside votes for its path of tags and classes,
with numbers in class names made equal. Votes are added up per host and path in Spark. Second pass: a page is read at the first
of its host's winning paths that holds most of what the page's own best container does, or at that one where none does; so a
host may have several templates, and a teaser with a winning name is not taken for an article.

Parts are left out by tag, or by a class, identifier or role that names them: a whole name (``comments``), or one made of such a
word and words for places and boxes (``site-header``). ``entry-header`` or ``legal-analysis`` name no such part. Whatever its name,
an element with most of an article's text is no such part either, nor is a section of an article that is named by a topic
(``discussion``, ``privacy``) and has a heading and a paragraph of its own, and neither a form nor named parts in it.

Paths are kept as numbers in a trie of (parent's number, tag and classes) and written out for the element voted for only, so memory
grows with the page, however deep it is.

Blocks: text between tags that begin or end a block; inside a block white space becomes one space, and character
references are decoded. A line break counts as white space. Blocks are joined by two line ends.

Defined cases
- null html is empty, an empty page or one without a container has empty text. Null or odd urls share the host "".
- unclosed, crossing and unknown tags never fail: an end tag without its start is passed over, a start tag ends at its
  parent's end at the latest. An element that holds no text of the page (svg, object and the like) is passed over up to its end; without
  one only its tag is. Custom elements are unknown ones. A label outside forms is text where it stands in a paragraph or list. Ties in votes go to the path with more text, then to the first path in code point order.
- rows that repeat a page are read each. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..sources.tables import read_table

#: Share of a host's votes that a path needs, so there are at most 50 to a host.
SHARE = 0.02
#: A container is entered while it holds this much of its parent's text, and what is outside has less than ``LITTLE`` of it in paragraphs.
MOST, LITTLE = 0.6, 0.05

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section td blockquote".split())
#: Raw text up to their end or the page's; and elements whose contents are passed over where they end.
RAW = frozenset("script style noscript iframe textarea title".split())
SKIPPED = frozenset("template svg object canvas audio video annotation annotation-xml".split())
#: Where a label is text.
PROSE = frozenset("p li dd blockquote td th figcaption".split())
CUT_TAGS = frozenset("nav footer aside form dialog menu button select option head header figure search fieldset input label".split())
NEVER_CUT = frozenset("html body main".split())
PAGE_TAGS = frozenset("article body center div form main section table tbody td tr".split())
_P, _LISTS = frozenset({"p"}), frozenset("ul ol dl table select".split())
ENDS_P = BLOCKS - {"option", "caption"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl div article section main body html td th li".split())
NOISE = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner "
        "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar topbar "
        "header masthead footer copyright legal sidebar sidebars aside rail widget widgets "
        "notice notices alert alerts cookie cookies consent gdpr privacy popup modal overlay newsletter subscribe subscription signup login "
        "comment comments commentlist disqus reply replies respond discussion feedback "
        "share sharing social related recommended recommendations trending popular tags search form skip"
    ).split()
)

# Fixed words: what may stand beside a word of NOISE in the name of such a part.
PLACES = frozenset(
    (
        "site page main global top bottom left right center middle upper lower primary secondary fixed sticky mobile desktop mini small large big wide "
        "box bar area block section container wrap wrapper inner outer panel pane list group slot unit zone region row col column item items content "
        "link links button buttons btn icon icons image img text title form field post posts entry article articles story stories news blog user reader readers "
        "the and with for by of no my new first last one two previous next media policy trail leave"
    ).split()
)
# Fixed words: words of NOISE that name a part of an article just as well, so that a name with ``article`` or ``post`` in it is none.
COMMON = frozenset("header legal banner notice notices alert alerts aside rail tags copyright search privacy popular trending feedback discussion overlay skip form".split())
#: Words of COMMON that an article may be about in a section of its own.
TOPICS = frozenset("discussion privacy legal copyright feedback popular trending search alert alerts".split())
TOPIC_CHARS = 80
OWN = frozenset("post posts entry article articles story stories news blog content text title section the and with for by of no my new".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(sorted(RAW))})(?![\w:-]).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SKIPPED}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


def is_noise(name: str) -> bool:
    """Whether a class, identifier or role names a part that is no article, by all of its words."""
    words = [w.lower() for w in _PARTS.findall(name)]
    found = {w for w in words if w in NOISE}
    if not found:
        return False
    rest = {w for w in words if len(w) > 1} - found
    return not rest or rest <= PLACES and not (found <= COMMON and rest & OWN)


def is_topic(name: str) -> bool:
    return name.lower() in TOPICS


class Page:
    """Elements of a page as parallel lists, and its blocks of text as (element, text, characters in links)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.cut = ["html"], [-1], [0], [False]
        self.in_article, self.topic = [False], [False]
        self.steps, self.above, self.known = [""], [-1], {}  # of the trie of paths: last step, number of what is before, and numbers
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        classes, noise, topic, cut = "", False, True, tag in CUT_TAGS
        if attributes and not attributes.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name == "class":
                    classes = ".".join(sorted(_DIGITS.sub("#", value).split()))
                if name in ("class", "id", "role"):
                    for word in value.split():
                        if is_noise(word):
                            noise, topic = True, topic and is_topic(word)
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    noise, topic = True, False
        inner = self.in_article[parent] or self.tag[parent] in ("article", "main")
        if tag == "header" and inner:
            cut = False  # the head of the article itself
        if tag == "figure":
            cut = False
        step = (self.path[parent], f"{tag}.{classes}" if classes else tag)
        if step not in self.known:
            self.known[step] = len(self.steps)
            self.above.append(step[0])
            self.steps.append(step[1])
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self.known[step])
        self.cut.append(cut or noise and tag not in NEVER_CUT)
        self.in_article.append(inner)
        self.topic.append(noise and topic and inner and tag == "section")
        return len(self.tag) - 1

    def path_of(self, element: int) -> str:
        """Tags and classes from the root down."""
        at, out = self.path[element], []
        while at:
            out.append(self.steps[at])
            at = self.above[at]
        return "".join(f">{step}" for step in reversed(out))

    def numbers_of(self, paths: list[str]) -> dict[str, int]:
        """Numbers of those of ``paths`` that the page has, found by one walk of the trie for each."""
        below: dict[int, list[int]] = {}
        for k in range(1, len(self.steps)):
            below.setdefault(self.above[k], []).append(k)
        found = {}
        for path in paths:
            reached = [(0, 0)]
            while reached:
                k, at = reached.pop()
                if at == len(path):
                    if k:
                        found[path] = k
                        break
                elif path[at] == ">":
                    reached += [(n, at + 1 + len(self.steps[n])) for n in below.get(k, ()) if path.startswith(self.steps[n], at + 1)]
        return found

    def _read(self, source: str) -> None:
        stack, pieces, links, owner, at = [0], [], 0, 0, 0
        depth_a, count, endless = 0, {}, set()  # open elements by tag; SKIPPED tags without an end from here on

        def flush() -> None:
            nonlocal pieces, links
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((owner, text, min(links, len(text))))
            pieces, links = [], 0

        def leave(tags: set[str] | frozenset[str], scopes: frozenset[str] = frozenset()) -> bool:
            """End the innermost open element of ``tags`` and what is open in it, unless one of ``scopes`` is open within."""
            if not any(count.get(t) for t in tags):
                return False
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in tags:
                    for e in stack[k:]:
                        count[self.tag[e]] -= 1
                    del stack[k:]
                    return True
                if self.tag[stack[k]] in scopes:
                    break
            return False

        while m := _TOKEN.search(source, at):
            if m.start() > at:
                piece = source[at : m.start()]
                if not pieces:
                    owner = stack[-1]
                pieces.append(piece)
                if depth_a:
                    links += len(piece)
            at = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag = tag.lower()
            if m[2] or m[5]:
                if tag == "a":
                    depth_a = max(0, depth_a - 1)
                elif tag in BLOCKS:
                    flush()
                    if leave({tag}, SCOPES if tag == "p" else frozenset()):
                        depth_a = 0
                elif tag in CUT_TAGS and count.get(tag):
                    flush()
                    leave({tag})
            elif tag in SKIPPED and tag not in endless:
                if not (m[4] or m[7] or "").endswith("/"):
                    end = _ENDS[tag].search(source, at)
                    if end:
                        at = end.end()
                    else:
                        endless.add(tag)
            elif tag == "a":
                depth_a += 1
            elif tag == "br":
                pieces.append(" ")
            elif tag == "label" and self.tag[stack[-1]] in PROSE:
                continue
            elif tag in BLOCKS or tag in CUT_TAGS and tag not in VOID:
                flush()
                if tag in ENDS_P:
                    leave(_P, SCOPES)
                if tag in SAME_ENDS:
                    leave(SAME_ENDS[tag], _LISTS)
                if tag not in VOID:
                    stack.append(self._open(tag, m[4] or m[7] or "", stack[-1]))
                    count[tag] = count.get(tag, 0) + 1
        if at < len(source):
            if not pieces:
                owner = stack[-1]
            pieces.append(source[at:])
        flush()
        self._keep_topics()
        # An element around the page's main heading or article, with most of the text, is the page itself, whatever its name; so
        # is one in an article with most of the article's text.
        size, main = [0] * len(self.tag), [False] * len(self.tag)
        for e, text, _ in self.blocks:
            size[e] += len(text)
        for e in range(len(size) - 1, 0, -1):
            up = self.parent[e]
            size[up] += size[e]
            main[up] = main[up] or main[e] or self.tag[e] in ("h1", "main") or self.tag[e] == "article" and not self.cut[e]
        article = [0] * len(size)
        for e in range(1, len(size)):
            up = self.parent[e]
            article[e] = up if self.tag[up] in ("article", "main") and not self.cut[up] else article[up]
            around = main[e] and size[e] > 0.5 * size[0] or article[e] and size[e] > 0.5 * size[article[e]]
            if self.cut[e] and around and self.tag[e] in PAGE_TAGS:
                self.cut[e] = False
            self.cut[e] = self.cut[e] or self.cut[up]

    def _keep_topics(self) -> None:
        """Sections named by a topic stay if they read like a part of the article."""
        if not any(self.topic):
            return
        head, prose, odd = set(), dict.fromkeys((e for e, t in enumerate(self.topic) if t), 0), set()
        for e, text, links in self.blocks:
            up = self.parent[e]
            if up in prose and self.tag[e] in ("h2", "h3", "h4", "h5", "h6"):
                head.add(up)
            elif up in prose and self.tag[e] == "p":
                prose[up] += len(text) - 2 * links
        inside = [-1] * len(self.tag)  # the topic's section that an element is in
        for e in range(1, len(self.tag)):
            inside[e] = self.parent[e] if self.parent[e] in prose else inside[self.parent[e]]
            if inside[e] >= 0 and (self.cut[e] or self.tag[e] in ("article", "li")):
                odd.add(inside[e])
        for e, chars in prose.items():
            if e in head and chars >= TOPIC_CHARS and e not in odd:
                self.cut[e] = False

    def weights(self) -> list[float]:
        """Of each element the characters of its own text that are neither cut nor in links."""
        weight = [0.0] * len(self.tag)
        for e, text, links in self.blocks:
            if not self.cut[e]:
                weight[e] += max(0, len(text) - 2 * links)
        return weight

    def best(self) -> tuple[int, float] | None:
        """The smallest container with most of the page's own text and all of its article, and that text's weight."""
        weight = self.weights()
        prose = [w if t in ("p", "li", "blockquote", "pre", "dd") else 0.0 for w, t in zip(weight, self.tag, strict=True)]
        heads = [int(w > 0 and t in ("h1", "h2", "h3")) for w, t in zip(weight, self.tag, strict=True)]
        for e in range(len(weight) - 1, 0, -1):
            for sums in (weight, prose, heads):
                sums[self.parent[e]] += sums[e]
        if not weight[0]:
            return None
        inside: dict[int, list[int]] = {}
        for e in range(1, len(weight)):
            inside.setdefault(self.parent[e], []).append(e)
        at = chosen = 0
        while nexts := [e for e in inside.get(at, ()) if weight[e] >= MOST * weight[at]]:
            into = nexts[0]
            inner = self.tag[at] in ("article", "main")
            if heads[at] > heads[into] or prose[at] - prose[into] > LITTLE * weight[at] or inner and weight[into] < weight[at]:
                break
            at = into
            if self.tag[at] in CONTAINERS:
                chosen = at
        return chosen, weight[chosen]

    def weight_at(self, path: int) -> float:
        """Weight of what ``text_at`` gives for a path's number."""
        inside = self._inside(path)
        return sum(w for w, i in zip(self.weights(), inside, strict=True) if i)

    def _inside(self, path: int) -> list[bool]:
        inside = [False] * len(self.tag)
        for e in range(len(inside)):
            inside[e] = e > 0 and inside[self.parent[e]] or self.path[e] == path and not self.cut[e]
        return inside

    def text_at(self, path: int) -> str | None:
        """Text of all elements with the path of this number, or None where there are none that are not cut."""
        inside = self._inside(path)
        if not any(inside):
            return None
        return "\n\n".join(text for e, text, _ in self.blocks if inside[e] and not self.cut[e])


def extract(source: str, paths: list[str]) -> str:
    """Text of a page, given the winning paths of its host, best first."""
    page = Page(source)
    own, known = page.best(), page.numbers_of(paths)
    if own is None:  # links alone, or nothing
        return next(filter(None, (page.text_at(known[p]) for p in paths if p in known)), "")
    least = own[1] * (1 - LITTLE)
    for path in paths:
        if path in known and page.weight_at(known[path]) >= least:
            return page.text_at(known[path]) or ""
    return page.text_at(page.path[own[0]]) or ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source)
            if own := page.best():
                out.append((host, page.path_of(own[0]), own[1]))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["host", "path", "weight"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(s, p or []) for s, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths that at least ``SHARE`` of a host's pages voted for, best first."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, weight double")
    sums = materialize(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("weight").alias("weight")), "html-votes")
    all_votes = sums.groupBy("host").agg(F.sum("votes").alias("all"))
    strong = sums.join(all_votes, "host").where(F.col("votes") >= SHARE * F.col("all"))  # at most 1 / SHARE to a host
    ranked = strong.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("weight")).alias("w"), "path"))).alias("r"))
    return ranked.select("host", F.transform("r", lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    paths = materialize(winning_paths(rows), "html-paths")  # a small table is sent to all tasks, a large one is joined by shuffle
    joined = rows.join(paths, "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "paths")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
