"""Main-text extraction with a site style tree.

All pages of a host are merged into one tree: an element node is a path of elements (tag, class and id), with the number of
pages that have it and the presentation styles seen below it (runs of its child elements); the texts found in it are its
content nodes, each with the number of pages that have it there. Importance follows the entropies, to base m, the number of
the element node's pages: one that its pages lay out in many ways has a high presentation entropy and matters, a content
that k pages share has an entropy of log k over them and matters by 1 - log k / log m. A content node's importance joins
both, presentation weighing more the more styles there are.

What a page loses are branches of low importance, decided where texts hang: an element node whose most important content
falls below LEAST_IMPORTANCE loses all of them, and of other nodes just the contents below it go. An element above
important text is therefore never cut, however much around that text repeats. A page that would keep nothing is a copy of
others, and keeps what its elements don't mark.

m pages can tell log2(m) bits, so that is what the entropies weigh; what an element says of itself is a prior that weighs
some bits of its own (PRIORS). Most elements are taken to matter until their repetition shows otherwise. Elements that
are no content by kind (nav, footer, aside, form; words for adverts, comments, menus, cookie notices) are taken not to,
firmly: adverts, comments and menus differ from page to page, so no entropy could find them. Words that may or may not
mean so (search, share, related, notice) weigh under a bit: contents that don't repeat overrule them from some 20 pages
on, and within a declared article they say nothing; no class speaks against its paragraphs, headings and tables. The running
text of a declared article, and whatever holds such an article, yields to the strongest repetition only, since copied
articles are still articles. Beside a declared article little repetition is enough. Nothing depends on a least number of
pages: one page tells no bits, and then the prior stands alone. Scripts, styles and the head are not text.

At scale: the tree is a table (host, node, ...), a node being the hash of its path, summed where pages are before it is
shuffled, so a host with a third of all pages costs no task more than its own. Contents of one page only, nearly all of
them, are never joined with anything. Pages are read twice and not shuffled: what they lose is broadcast if it is
MAX_BROADCAST branches at most. If it is more, each page's own list is found by a join on host and branch, and pages are
joined to their lists by the digest of their url and html.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, map_arrow, materialize

GAMMA, LEAST_IMPORTANCE, MAX_BROADCAST = 0.9, 0.85, 50_000
#: What elements say of themselves: (importance, bits that it weighs).
PRIORS = {"marked": (0.0, 8.0), "worded": (0.0, 0.75), "declared": (1.0, 64.0), "beside": (1.0, 2.0), "plain": (1.0, 8.0)}
MARKED, DECLARED, BESIDE, WORDED = 1, 2, 4, 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
_OUT = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu", "title", "xmp", "noembed", "noframes"}
_OUT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "complementary", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "popup", "promo", "sidebar", "sponsor", "sponsored"}
_MAYBE_WORDS = {"banner", "notice", "related", "reply", "search", "share", "sharing", "social", "subscribe", "toolbar"}
#: Running text in which an article's own classes say nothing.
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "table", "tbody", "thead", "tr", "td", "th", "dl", "dt", "dd"}
_RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figcaption", "table", "tbody", "thead", "tr", "td", "th", "article", "main", "html", "body"}
#: An opening tag ends an open element of the second set, up to an element of the third.
_SIBLING = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_SCOPE = {"td", "th", "button", "object", "table"}


def node_id(parent: int, name: str) -> int:
    """The node `name` below `parent` (0: the root), as a signed 64-bit hash of the whole path."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(name.encode("utf-8", "surrogatepass"), parent + (1 << 63)) - (1 << 63)


def _value(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _words(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


class _Element:
    __slots__ = ("tag", "node", "block", "out", "maybe", "own", "running", "children")

    def __init__(self, tag: str, node: int, block: int, out: bool, maybe: bool, own: bool, running: bool):
        self.tag, self.node, self.block, self.out, self.maybe, self.own, self.running, self.children = tag, node, block, out, maybe, own, running, []


class Page:
    """A parsed page: its blocks of text in order, each a list of (node, text) runs, one unless an inline element is marked
    as no content; its nodes; their styles; nodes marked as no content, firmly or by a word that may mean so; nodes of declared
    running text and what holds it; nodes beside a declared article. Time and memory grow with the page's length, however
    deep its elements are nested."""

    def __init__(self, source: str):
        self.blocks: list[list[tuple[int, str]]] = []
        self.nodes: set[int] = set()
        self.styles: set[tuple[int, int]] = set()
        self.marked: set[int] = set()
        self.worded: set[int] = set()
        self.declared: set[int] = set()
        self._articles = 0
        self._stack = [_Element("", 0, 0, False, False, False, True)]
        self._opened: Counter = Counter()
        self._parts: list[tuple[int, str]] = []
        at, end = 0, len(source)
        lower = None
        while at < end:
            found = _TOKEN.search(source, at)
            if not found:
                break
            if found.start() > at:
                self._parts.append((self._stack[-1].block, source[at : found.start()]))
            at = found.end()
            slash, tag, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self._close(tag)
                continue
            self._open(tag, rest)
            if tag in _RAW and not rest.endswith("/"):
                lower = source.lower() if lower is None else lower
                stop = lower.find(f"</{tag}", at)
                at = end if stop < 0 else stop
        if at < end:
            self._parts.append((self._stack[-1].block, source[at:]))
        self._flush()
        self._pop_to(1)

    def _flush(self) -> None:
        if self._parts:
            if all(node == self._parts[0][0] for node, _ in self._parts):
                text = _words("".join(part for _, part in self._parts))
                if text:
                    self.blocks.append([(self._parts[0][0], text)])
            else:
                runs: list[tuple[int, str]] = []
                for node, part in self._parts:
                    if runs and runs[-1][0] == node:
                        runs[-1] = (node, runs[-1][1] + part)
                    else:
                        runs.append((node, part))
                self.blocks.append(runs)
            self._parts.clear()

    def _pop_to(self, i: int) -> None:
        if any(n.tag not in _INLINE for n in self._stack[i:]):
            self._flush()
        while len(self._stack) > i:
            element = self._stack.pop()
            self._opened[element.tag] -= 1
            if element.children:
                runs = [c for i, c in enumerate(element.children) if not i or c != element.children[i - 1]]
                self.styles.add((element.node, _value(" ".join(runs))))

    def _close(self, tag: str) -> None:
        if not self._opened[tag]:
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                self._pop_to(i)
                return
            if tag in _INLINE and self._stack[i].tag not in _INLINE:
                return

    def _end_implied(self, tag: str) -> None:
        """Close what the opening of a block element ends: a paragraph, or an element of its own kind."""
        stack = self._stack
        if self._opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    self._pop_to(i)
                    break
                if stack[i].tag in _P_SCOPE:
                    break
        if tag in _SIBLING:
            same, scope = _SIBLING[tag]
            if any(self._opened[x] for x in same):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in scope:
                        break
                    if stack[i].tag in same:
                        self._pop_to(i)
                        break

    def _open(self, tag: str, rest: str) -> None:
        if tag in _VOID:
            self._parts.append((self._stack[-1].block, " ")) if tag == "br" else tag == "hr" and self._flush()
            return
        inline = tag in _INLINE
        if not inline:
            self._end_implied(tag)
            self._flush()
        over, name, words = self._stack[-1], tag, ()
        if "=" in rest:
            for m in _NAMES.finditer(rest):
                value = (m[2] or m[3] or m[4] or "").lower()
                words = [*words, *_WORDS.findall(value)]
                name += {"class": ".", "id": "#"}.get(m[1].lower(), "@") + "_".join(value.split())
        article = tag in ("article", "main") or "main" in words and "@main" in name
        own = over.own or article
        kind = over.out or tag in _OUT or tag == "header" and not over.own
        frame = tag in ("html", "body", "article", "main")
        silent = frame or over.own and over.running and tag in _TEXT
        out = kind or not silent and not _OUT_WORDS.isdisjoint(words)
        maybe = over.maybe or not silent and not over.own and not inline and not _MAYBE_WORDS.isdisjoint(words)
        if not inline:
            over.children.append(name)
        running = over.running and (inline or tag in _RUNNING)
        block = node = over.node if inline else node_id(over.node, name)
        if inline:
            block = over.block if over.out or not out else node_id(over.block, name)
            if block != over.block:
                self.nodes.add(block)
                self.marked.add(block)
        else:
            self.nodes.add(node)
            if out:
                self.marked.add(node)
            elif maybe and not article:
                self.worded.add(node)
            elif own and running:
                self.declared.add(node)
            if article and not out and not over.own:
                self._articles += 1
                self.declared.update(x.node for x in self._stack if x.node and not x.out)
        self._opened[tag] += 1
        self._stack.append(_Element(tag, node, block, out, maybe and not article, own, running))

    def flags(self) -> dict[int, int]:
        """What the page's elements say of its nodes; 0 is left out."""
        own = {n: MARKED for n in self.marked}
        for n in self.worded:
            own[n] = own.get(n, 0) | WORDED
        for n in self.declared:
            own[n] = own.get(n, 0) | DECLARED
        if self._articles:
            for n in self.nodes:
                own.setdefault(n, BESIDE)
        return own

    def contents(self) -> set[tuple[int, int]]:
        """(node, value) of the page's texts."""
        held = {(node, text if len(runs) == 1 else _words(text)) for runs in self.blocks for node, text in runs}
        return {(node, _value(text)) for node, text in held if text}

    def text(self, removed: set[int]) -> str:
        """The main text without the removed branches: nodes, or contents by their mark. If nothing is left, the page is a copy
        of others, and all that its elements don't mark stays."""

        def kept(stays: Callable[[int, str], bool]) -> str:
            out = []
            for runs in self.blocks:
                if len(runs) == 1:
                    text = runs[0][1] if stays(*runs[0]) else ""
                else:
                    text = _words("".join(part for node, part in runs if stays(node, _words(part))))
                if text:
                    out.append(text)
            return "\n".join(out)

        return kept(lambda node, text: node not in removed and mark(node, _value(text)) not in removed) or kept(lambda node, _: node not in self.marked and node not in self.worded)


def mark(node: int, value: int) -> int:
    """The number of a content node among the branches of a host."""
    return node ^ value


def host_of(url: str | None) -> str:
    """The url's host in lower case, '' where there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for i in range(batch.num_rows):
            page, host = Page(batch.column(2)[i].as_py() or ""), host_of(batch.column(1)[i].as_py())
            rows = {("style", node, style) for node, style in page.styles}
            rows |= {("content", node, value) for node, value in page.contents()}
            rows |= {("page", node, 0) for node in page.nodes} | {("flags", *x) for x in page.flags().items()}
            seen.update((host, *r) for r in rows)
        rows = [(*k, n) for k, n in seen.items()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=["host", "kind", "node", "value", "n"])


def _own_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            page, host = Page(batch.column(2)[i].as_py() or ""), host_of(batch.column(1)[i].as_py())
            rows += [(batch.column(0)[i].as_py(), host, branch) for branch in page.nodes | {mark(*x) for x in page.contents()}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["key", "host", "branch"])


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def observations(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, k): pages that have a node, its styles and its contents, and what its elements say of it;
    counted within batches before they are shuffled."""
    seen = materialize(map_arrow(_source(pages), _observe, "host string, kind string, node long, value long, n long"), "style-observations")
    return materialize(seen.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("k")), "style-counts")


def importance(k: Column) -> Column:
    """Of a content that k of its node's pages have; the node's row of style_tree gives the rest."""
    bits = F.log2(F.col("pages").cast("double"))
    content = F.when(F.col("pages") > 1, 1 - F.log2(k.cast("double")) / bits).otherwise(1.0)
    keep = F.pow(F.lit(GAMMA), F.col("styles").cast("double"))
    entropy = (1 - keep) * F.col("presentation") + keep * F.greatest(F.lit(0.0), content)
    given, weighs = (F.create_map(*(F.lit(x) for name, prior in PRIORS.items() for x in (name, prior[i])))[F.col("says")] for i in (0, 1))
    return (weighs * given + bits * entropy) / (weighs + bits)


def style_tree(observed: DataFrame) -> DataFrame:
    """One row per host and element node with texts: pages, styles, presentation (entropy, 0 to 1), says (a key of PRIORS, by
    what any of its elements says), shared (contents that several pages have), and the importance of its most and of its
    least important content (best, worst)."""
    k = F.col("k").cast("double")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    nodes = observed.groupBy("host", "node").agg(
        F.sum(of("page", F.col("k"))).alias("pages"), F.sum(of("style", k)).alias("sk"), F.sum(of("style", k * F.log2(k))).alias("sl"), F.count(of("style", 1)).alias("styles"),
        F.min(of("content", F.col("k"))).alias("least"), F.max(of("content", F.col("k"))).alias("most"), F.count(F.when((F.col("kind") == "content") & (F.col("k") > 1), 1)).alias("shared"),
        F.coalesce(F.bit_or(of("flags", F.col("value"))), F.lit(0)).alias("flags"),
    )
    nodes = nodes.filter("least IS NOT NULL")
    share = F.when(F.col("pages") > 1, (F.log2("sk") - F.col("sl") / F.col("sk")) / F.log2(F.col("pages").cast("double"))).otherwise(1.0)
    presentation = F.when(F.col("styles") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0)
    has = lambda flag: F.col("flags").bitwiseAND(F.lit(flag)) > 0
    says = F.when(has(MARKED), "marked").when(has(WORDED), "worded").when(has(DECLARED), "declared").when(has(BESIDE), "beside").otherwise("plain")
    tree = nodes.withColumns({"presentation": presentation, "says": says})
    return tree.withColumns({"best": importance(F.col("least")), "worst": importance(F.col("most"))}).select("host", "node", "pages", "styles", "presentation", "says", "shared", "best", "worst")


def removed_branches(observed: DataFrame) -> DataFrame:
    """(host, branch): the element nodes, and of other nodes the contents (by their mark), that pages lose."""
    tree = materialize(style_tree(observed).filter(F.col("worst") < LEAST_IMPORTANCE), "style-nodes")
    whole = tree.filter(F.col("best") < LEAST_IMPORTANCE).select("host", F.col("node").alias("branch"))
    mixed = tree.filter(F.col("best") >= LEAST_IMPORTANCE)
    texts = lookup(observed.filter("kind = 'content' AND k > 1").select("host", "node", "value", "k"), mixed, ["host", "node"], "shared")
    return whole.unionByName(texts.filter(importance(F.col("k")) < LEAST_IMPORTANCE).select("host", F.col("node").bitwiseXOR(F.col("value")).alias("branch")))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks in page order, joined by a line end; empty if none), n_chars.

    A null html is an empty page; a null or broken url belongs to a host named ''. Character references are decoded,
    white space within a block becomes one space, and a br counts as white space. A tag whose quotes don't close ends at
    its first >. Elements may be nested to any depth. Each row, repeated or not and whatever its page_id, is judged by its
    own url and html. Other columns are not read; an empty table gives an empty result."""
    removed = materialize(removed_branches(observations(pages)), "style-removed")
    rows = _source(pages)
    by_host: dict[str, set[int]] | None = None
    if removed.count() <= MAX_BROADCAST:
        by_host = {}
        for r in removed.collect():
            by_host.setdefault(r["host"], set()).add(r["branch"])
        rows = rows.withColumn("removed", F.lit(None).cast("array<long>"))
    else:
        rows = rows.withColumn("key", F.sha2(F.concat_ws("\x00", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256))
        own = map_arrow(rows.select("key", "url", "html"), _own_branches, "key string, host string, branch long").groupBy("key", "host", "branch").agg(F.count("*").alias("n"))
        lists = own.join(removed, ["host", "branch"]).groupBy("key").agg(F.collect_set("branch").alias("removed"), F.max("n").alias("n"))  # a page's own branches
        rows = lookup(rows, materialize(lists, "style-lists"), ["key"], "n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                gone = set(batch.column(3)[i].as_py() or ()) if by_host is None else by_host.get(host_of(batch.column(1)[i].as_py()), set())
                texts.append(Page(batch.column(2)[i].as_py() or "").text(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(rows.select("page_id", "url", "html", "removed"), work, "page_id long, url string, text string, n_chars long")
