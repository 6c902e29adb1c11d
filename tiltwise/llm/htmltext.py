"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree.  Its nodes, the branches, are elements with a presentation (tag with class,
id and role; sections also without), by their path; plain elements belong to the branch they stand in.  Each branch keeps on
how many pages it has which child branches and which texts.  Its importance is entropy-based: how varied its presentations
are, and how much its texts differ from page to page, folded up the tree.  Pages whose texts are wholly equal count once, so
copies of a page do not make its article look like a frame.

Entropies alone cannot tell an advert that changes with every page from an article, so what the markup says is a feature of
importance: links, navigation, headers, footers, sidebars, notices, adverts and comments make a branch less important, so
does an article or main element elsewhere on the page, and being one makes it more so.  Every branch is judged, inside
articles too, and what is cut from a page is just the branches of low importance.

A host's evidence grows with its pages: importance is the mean of its own tree, of the tree shared by all hosts (which weighs
as much as ``shared`` pages at most) and of a neutral page, so hosts of every size are judged in one way.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, host_of, materialise

#: HTML elements by how they end and what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an element's start closes if it is open, and the elements in which the search for it ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ()),
}
#: Elements that hold no text of the page, and those that need not hold main text.
NO_TEXT = frozenset("script style noscript template button select textarea input iframe object embed svg canvas audio video map dialog head title datalist".split())
FRAME_TAGS = frozenset("nav aside footer menu form".split())
#: What speaks against main text: roles, and words in class or id.
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion sidebar sidebars "
    "menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist disqus reply replies respond share sharing social related recommended widget widgets pager "
    "pagination paging toolbar skip".split()
)
#: Of those, what readers write: not main text even where it is marked up as articles.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: A class name with one of these says what the page has elsewhere (as in "has-sidebar").
ELSEWHERE = frozenset("has with no without".split())
KEPT = frozenset(("html", "body", "article", "main"))
#: Elements that are style nodes whether they have a class or not.
SECTIONS = frozenset("address article aside details dialog figure footer form header main menu nav section".split())
DEEPEST = 24  # levels of branches; what is styled below belongs to the branch there
CLIMB = 512  # levels that are searched for an element which a new one closes
WEAK = 0.1  # what is left of the importance of a branch for each thing that speaks against it
FLOOR = 0.5  # of the entropies of an article or main element, as articles may repeat
_SIMPLE = re.compile(r"</?([a-zA-Z][^\s/>]*)\s*/?>")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_IS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "style", "against", "readers", "hidden", "children", "holds", "block")

    def __init__(self, tag: str, style: str, against: bool = False, readers: bool = False, hidden: bool = False):
        self.tag, self.style, self.against, self.readers, self.hidden, self.children, self.holds = tag, style, against, readers, hidden, [], False


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[int, dict[str, str], bool]:
    """Where a tag ends, its attributes and whether it closes itself; every character is looked at once.

    A quoted value that never ends is read as one without quotes.  A tag that never ends takes the rest of the page.
    """
    found: dict[str, str] = {}
    size = len(page)
    while True:
        gap = _GAP.match(page, at).end()
        if gap >= size or page[gap] == ">":
            return gap + 1, found, gap > at and page[gap - 1] == "/"
        at = _KEY.match(page, gap).end()
        key = page[gap:at].lower()
        value = ""
        given = _IS.match(page, at)
        if given:
            at = given.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote and last.setdefault(quote, page.rfind(quote)) > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                end = _BARE.match(page, at).end()
                value, at = page[at:end].strip("\"'"), end
        found.setdefault(key, html_lib.unescape(value) if "&" in value else value)


def _element(tag: str, a: dict[str, str]) -> Node:
    if not a:
        return Node(tag, tag, tag in FRAME_TAGS)
    named = " ".join((a.get("class", ""), a.get("id", ""))).strip().lower()
    role = a.get("role", "").lower()
    style = tag + (f".{' '.join(_DIGITS.sub('#', named).split())}" if named else "") + (f"@{role}" if role else "")
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")) is not None
    names: set[str] = set()
    for one in named.split():
        words = _NAME.findall(one)
        if not ELSEWHERE & set(words):
            names.update(words)
    readers = tag not in ("html", "body", "main") and bool(names & READERS)
    against = tag in FRAME_TAGS or readers or role in CUT_ROLES or (tag not in KEPT and bool(names & CUT_NAMES))
    style = style.replace("/", "|")
    # A long name goes on as its hash, so that two of them stay two.
    return Node(tag, style if len(style) <= 200 else f"{style[:160]}~{xxhash.xxh3_128_hexdigest(style.encode('utf-8', 'surrogatepass'))}", against, readers, hidden)


def parse(page: str | None) -> Node:
    """The page as a tree; strings are text.  Unclosed and stray tags are mended as browsers do for common cases.

    The time is linear in the page, however broken its markup is.
    """
    page = page or ""
    root = Node("", "")
    root.block = root
    stack, opened, last = [root], Counter(), {}
    place, size = 0, len(page)

    def shut(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    while place < size:
        at = page.find("<", place)
        if at < 0:
            stack[-1].children.append(page[place:])
            break
        m = _TAG.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?", "/"):  # a bare sign
            stack[-1].children.append(page[place : at + 1])
            place = at + 1
            continue
        if at > place:
            stack[-1].children.append(page[place:at])
        if m is None:
            sign = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(sign, at + (2 if len(sign) > 1 else 1))
            place = size if end < 0 else end + len(sign)
            continue
        tag = m[1].lower()
        if (plain := _SIMPLE.match(page, at)) is not None:
            place, found, alone = plain.end(), {}, page[plain.end() - 2] == "/"
        else:
            place, found, alone = _attributes(page, m.end(), last)
            if place > size:  # unfinished
                break
        if page[at + 1] == "/":
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                shut(depth)
            continue
        if tag in BLOCK and stack[-1].block.tag == "p":  # a paragraph ends where a block begins
            ends = stack[-1].block
            depth = len(stack) - 1
            while stack[depth] is not ends:
                depth -= 1
            shut(depth)
        if tag in CLOSES and any(opened[t] for t in CLOSES[tag][0]):
            own, until = CLOSES[tag]
            depth, lowest = len(stack) - 1, max(0, len(stack) - CLIMB)
            while depth > lowest and stack[depth].tag not in own and stack[depth].tag not in until:
                depth -= 1
            if stack[depth].tag in own:
                shut(depth)
        node = _element(tag, found)
        node.block = node if tag in BLOCK else stack[-1].block
        stack[-1].children.append(node)
        if tag in ("article", "main"):
            for up in reversed(stack):
                if up.holds:
                    break
                up.holds = True
        if tag in RAW:
            end = _RAW_END[tag].search(page, place)
            node.children.append(page[place : end.start() if end else size])
            place = end.end() if end else size
        elif tag not in VOID and not alone:
            stack.append(node)
            opened[tag] += 1
    return root


class Branch:
    """A style node on one page: its path, what speaks for and against it, and its own texts."""

    __slots__ = ("path", "parent", "depth", "against", "inside", "main", "frame", "texts", "chars", "links", "below", "factor", "low")

    def __init__(self, path: str, parent: Branch | None, depth: int, against: bool, inside: bool, main: bool, frame: bool):
        self.path, self.parent, self.depth, self.against, self.inside, self.main, self.frame = path, parent, depth, against, inside, main, frame
        self.texts, self.chars, self.links, self.below, self.factor, self.low = [], 0, 0, [], 1.0, False


def read_page(page: str | None) -> tuple[list[Branch], list[tuple[Branch, str]]]:
    """The branches of a page, parents first, and its blocks of text in page order.

    A branch that holds an article is a frame around it and cannot be judged as a whole; its own text is a branch "#".
    ``factor`` is what markup says of a branch: 1, less for links, for noise and for what stands beside an article.
    """
    top = Branch("", None, 0, False, False, False, True)
    branches, known = [top], {}
    blocks: list[tuple[Branch, str]] = []
    text: list[str] = []
    linked = 0

    def under(at: Branch, style: str, against: bool, inside: bool, main: bool, frame: bool) -> Branch:
        path = f"{at.path}/{style}{'*' if frame else ''}"
        if path not in known:
            known[path] = Branch(path, at, at.depth + 1, against, inside, main, frame)
            branches.append(known[path])
            at.below.append(path)
        return known[path]

    def flush(at: Branch) -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if joined:
                if at.frame:
                    at = under(at, "#", at.against, at.inside, at.main, False)
                at.texts.append(joined)
                at.chars += len(joined)
                at.links += min(linked, len(joined))
                blocks.append((at, joined))
            linked = 0

    # An explicit stack, as pages may be nested deeply: (node, branch, inside a link, next child).
    stack: list[list] = [[parse(page), top, False, 0]]
    while stack:
        here = stack[-1]
        node, at, link, i = here
        if i == len(node.children):
            if node.tag in BLOCK:
                flush(at)
            stack.pop()
            continue
        here[3] += 1
        child = node.children[i]
        if isinstance(child, str):
            text.append(child)
            linked += len(child) if link else 0
            continue
        tag = child.tag
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
            continue
        if tag == "hr":
            flush(at)
            continue
        block = tag in BLOCK
        against = child.against and (at.inside or child.readers or (tag in FRAME_TAGS and tag != "form") or not child.holds)
        if tag in NO_TEXT or child.hidden or (tag == "form" and not child.holds) or (against and not block):
            if block:
                flush(at)
            continue
        own = at
        if block:
            flush(at)
            against = against or (tag == "header" and not at.inside and not child.holds)
            if (tag in SECTIONS or child.style != tag) and tag not in ("html", "body") and at.depth < DEEPEST:
                main = tag in ("article", "main") and not against and not at.against
                own = under(at, child.style, at.against or against, (at.inside or main) and not (at.against or against), main, child.holds)
        stack.append([child, own, link or tag == "a", 0])
    flush(top)
    has_main = any(b.inside for b, _ in blocks)
    for b in reversed(branches):
        if b.parent is not None:
            b.parent.chars += b.chars
            b.parent.links += b.links
    for b in branches:
        beside = has_main and not b.inside and not b.frame
        loose = 1.0 if b.inside or b.frame or b.parent.parent is None and b.path.endswith("#") else 1 - b.links / max(1, b.chars)
        b.factor = loose * (WEAK if b.against else 1) * (WEAK if beside else 1)
    return branches, blocks


def kept_text(page: str | None, low: frozenset[str] | set[str]) -> tuple[str, int]:
    """The text of a page without the branches whose paths are in ``low``, and how many branches are cut."""
    branches, blocks = read_page(page)
    cut = 0
    for b in branches:
        b.low = (b.parent is not None and b.parent.low) or b.path in low
        cut += b.path in low
    return "\n".join(t for b, t in blocks if not b.low), cut


def main_text(page: str | None, threshold: float = 0.15) -> str:
    """The main text of a page of which no other of its site is known: its markup alone decides."""
    return kept_text(page, {b.path for b in read_page(page)[0] if not b.frame and b.factor < threshold})[0]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def style_counts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``host, html``: what each branch shows and says on which pages, and what its markup says.

    ``host, path, kind, feature, page``: for each presentation (s, its set of child branches) and each text (t) of a branch the
    pages that have it, as hashes of all that the page says.  ``host, path, n, factor, main``: on how many pages the branch
    is, with the sums of their factors and of how often it is an article.  Both are counted in each batch before a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            features: set = set()
            marks: dict = {}
            for host, page in zip(b["host"], b["html"], strict=True):
                branches, blocks = read_page(page)
                said = _hash("\n".join(t for br, t in blocks if br.factor > WEAK))
                for br in branches:
                    if not br.frame:
                        features.update((host, br.path, "t", _hash(t), said) for t in br.texts)
                        features.add((host, br.path, "s", _hash("\n".join(sorted(br.below))), said))
                        mark = marks.setdefault((host, br.path), [0, 0.0, 0])
                        mark[0] += 1
                        mark[1] += br.factor
                        mark[2] += br.main
            rows = [(*f, 0, 0.0, 0) for f in features] + [(*k, "m", 0, 0, *m) for k, m in marks.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "kind", "feature", "page", "n", "factor", "main"])

    schema = "host string, path string, kind string, feature long, page long, n long, factor double, main long"
    both = materialise(pages.select("host", "html").mapInPandas(run, schema), "style_counts")
    return both.where("kind <> 'm'").select("host", "path", "kind", "feature", "page"), both.where("kind = 'm'").select("host", "path", "n", "factor", "main")


def _entropies(counts: DataFrame, keys: list[str], damping: float) -> DataFrame:
    """``keys, path, entropy, pages`` from ``keys, path, kind, feature, n``: the importance of each branch before its markup counts.

    Entropies are to the base of the pages that have the branch: 0 for what is the same on all, 1 for what differs on each.
    """
    # Sums of n and n log n are enough, so nothing but sums is dealt by path.
    def total(kind: str, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))

    sums = counts.groupBy(*keys, "path").agg(
        total("s", F.col("n")).alias("pages"), total("s", F.col("n") * F.log("n")).alias("shown"), total("t", F.col("n")).alias("texts"), total("t", F.col("n") * F.log("n")).alias("alike")
    )
    sums = sums.withColumn("said", F.col("texts") - F.when(F.col("pages") > 1, F.col("alike") / F.log("pages")).otherwise(0.0))
    # A branch's texts count for itself and all above it, less with each level.
    parts = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), F.pow(F.lit(damping), F.size(parts) - i).alias("weight")))
    above = sums.where("texts > 0").select(*keys, F.explode(prefix).alias("a"), "texts", "said").select(*keys, F.col("a.path").alias("path"), (F.col("texts") * F.col("a.weight")).alias("texts"), (F.col("said") * F.col("a.weight")).alias("said"))
    folded = above.groupBy(*keys, "path").agg((F.sum("said") / F.sum("texts")).alias("all_said"))
    varied = F.when(F.col("pages") > 1, (F.log("pages") - F.col("shown") / F.col("pages")) / F.log("pages")).otherwise(0.0)
    return sums.join(folded, [*keys, "path"]).select(*keys, "path", ((1 - damping) * varied + damping * F.col("all_said")).alias("entropy"), "pages")


def branch_importance(pages: DataFrame, shared: int = 8, damping: float = 0.9) -> DataFrame:
    """``host, path, pages, importance`` of every branch of ``host, html`` that has text and is no frame around an article."""
    features, marks = style_counts(pages)
    by_host = materialise(features.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n")), "by_host")
    own = _entropies(by_host, ["host"], damping)
    everywhere = by_host.groupBy("path", "kind", "feature").agg(F.sum("n").alias("n"))
    common = _entropies(everywhere, [], damping).select("path", F.col("entropy").alias("common"), F.least(F.col("pages") - 1, F.lit(shared)).alias("weight"))
    marked = marks.groupBy("host", "path").agg((F.sum("factor") / F.sum("n")).alias("factor"), (F.sum("main") / F.sum("n")).alias("main"))
    joined = own.join(common, "path").join(marked, ["host", "path"])
    entropy = ((F.col("pages") - 1) * F.col("entropy") + F.col("weight") * F.col("common") + 1) / (F.col("pages") + F.col("weight"))
    importance: Column = F.col("factor") * F.greatest(entropy, F.when(F.col("main") > 0.5, F.lit(FLOOR)).otherwise(0.0))
    return joined.select("host", "path", "pages", importance.alias("importance"))


def extract_text(pages: DataFrame, threshold: float = 0.15, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Return ``page_id, url, text, n_chars, n_cut`` for every row of ``pages``; ``n_cut`` branches of the page were cut.

    Blocks are joined by a line feed in page order; white space inside one becomes a space.  A null page has an empty text;
    pages without a host are those of one host; rows that repeat are extracted each and count once in the tree; branches of
    the same importance are cut or stay alike; other columns are ignored; an empty table gives no rows.  Whole pages are
    read, of any depth and length.
    """
    picked = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    judged = branch_importance(picked, **options).where(F.col("importance") < threshold)
    low = materialise(judged.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "low")
    # A host's list is small; where the lists of all hosts are not, pages of a large host are split by the planner.
    joined = picked.join(low, "host", "left").select("page_id", "url", "html", "low")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [kept_text(page, frozenset(low) if low is not None else frozenset()) for page, low in zip(b["html"], b["low"], strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [t for t, _ in found], "n_chars": [len(t) for t, _ in found], "n_cut": [n for _, n in found]})

    kind = picked.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long, n_cut long").select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_cut")
