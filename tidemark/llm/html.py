"""Main text of web pages by scoring the containers in their element tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tidemark.llm.frames import pieces, reach_workers

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"'<=]++|=\s*\"[^\"]*+\"|=\s*'[^']*+'|[\"'=])*+)(?:>|(?=<)|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Text inside these is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
OUTSIDE = frozenset(
    "head nav footer aside form script style title textarea select button option noscript iframe object svg canvas math "
    "template dialog menu audio video map xmp noembed noframes datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "html body article section main div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption figure "
    "figcaption address header footer nav aside form fieldset hgroup details summary center hr menu dialog search".split()
) | HEADINGS
#: A start tag of the set ends an open element of the same set that is not inside one of the fences.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Words in a class, id or role that mark a part as something other than main text.
_AROUND = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer footnav comment comments commentlist respond disqus reply replies cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended pagination pager "
    "toolbar widget masthead skip search complementary contentinfo paywall disclaimer".split()
)
#: Words that say the contrary and win.
_INSIDE = frozenset("article content entry post story main body text hentry".split())


@dataclass
class _Tree:
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    #: 0 main text may be here, 1 not, 2 only headings (a header within an article).
    outside: list[int] = field(default_factory=list)
    #: (element, text, characters inside links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _outside(tag: str, attributes: str, within: int, in_article: bool) -> int:
    if within == 1 or tag in OUTSIDE:
        return 1
    if tag == "header":
        return 2 if in_article else 1
    if attributes and not attributes.isspace():
        values: dict[str, str] = {}
        for match in _ATTRIBUTE.finditer(attributes):
            values.setdefault(match[1].lower(), match[2] or match[3] or match[4] or "")
        if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(values.get("style", "")):
            return 1
        for name in ("class", "id", "role"):
            words = {w.lower() for w in _WORDS.findall(values.get(name, ""))}
            # A part of comments stays one even if it is called their content.
            if words & _AROUND and tag not in ("html", "body", "article", "main"):
                if not words & _INSIDE or words & {"comment", "comments", "commentlist", "ad", "ads", "sidebar"}:
                    return 1
            if "header" in words and not words & _INSIDE and tag not in ("html", "body", "article", "main"):
                return 2 if in_article else 1
    return within


def parse(page: str) -> _Tree:
    """The tree of elements with the blocks of text in page order.

    Start tags end what they cannot stand in, end tags end everything opened since; unclosed elements last to the end of
    their parent. Character references are decoded, white space inside a block becomes one space.
    """
    tree = _Tree([""], [-1], [0])
    stack, articles, links = [0], 0, 0
    gathered: list[str] = []
    linked = 0
    # How often each tag is open: most tags need no walk along the stack, however deep a page is nested.
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if gathered:
            text = " ".join("".join(gathered).split())
            if text:
                owner = next((n for n in reversed(stack) if n == 0 or tree.tags[n] in BLOCKS), 0)
                # Inline parts may be outside as well, but then their text was not gathered.
                tree.blocks.append((owner, text, min(linked, len(text))))
            gathered.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and tree.outside[stack[-1]] != 1:
            text = unescape(text) if "&" in text else text
            gathered.append(text)
            if links:
                linked += len(text.strip())

    def close(depth: int) -> None:
        nonlocal articles, links
        for n in stack[depth:]:
            articles -= tree.tags[n] in ("article", "main")
            links -= tree.tags[n] == "a"
            opened[tree.tags[n]] -= 1
        del stack[depth:]

    place = 0
    while (token := _TOKEN.search(page, place)) is not None:
        add(page[place : token.start()])
        place = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if tag == "br" or tag == "wbr":
            if tag == "br":
                add(" ")
            continue
        if token[1]:
            if tag == "p" and not opened["p"]:
                flush()
            depth = next(i for i in range(len(stack) - 1, 0, -1) if tree.tags[stack[i]] == tag) if opened[tag] else 0
            if depth:
                if any(tree.tags[n] in BLOCKS for n in stack[depth:]):
                    flush()
                close(depth)
            continue
        if tag in BLOCKS:
            flush()
            # A paragraph holds no block; a formatting element left open inside it ends with it.
            depth = next(i for i in range(len(stack) - 1, 0, -1) if tree.tags[stack[i]] == "p") if opened["p"] else 0
            if depth and not any(tree.tags[n] in ("td", "th", "object", "button") for n in stack[depth:]):
                close(depth)
        if tag in _ENDS:
            ended, fences = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ended) else ():
                if tree.tags[stack[i]] in fences:
                    break
                if tree.tags[stack[i]] in ended:
                    flush()
                    close(i)
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, place)
            end = page.find(">", stop.end()) if stop else -1
            place = end + 1 if end >= 0 else len(page)
            continue
        kind = _outside(tag, token[3], tree.outside[stack[-1]], articles > 0)
        tree.tags.append(tag)
        tree.parents.append(stack[-1])
        tree.outside.append(kind)
        stack.append(len(tree.tags) - 1)
        opened[tag] += 1
        articles += tag in ("article", "main")
        links += tag == "a"
    add(page[place:])
    flush()
    return tree


def _points(text: str) -> float:
    """Of a paragraph: for being one, for its commas and for its length."""
    commas = text.count(",") + text.count("，") + text.count("、") + text.count("،")
    return 1 + commas + min(len(text) / 100, 3)


def main_text(page: str | None) -> str:
    """The blocks of the best container and of its kept siblings, one a line; empty if there is no text.

    Paragraphs give their points to their parent and half of them to its parent; a container's sum is reduced by the
    share of its text that stands in links. The container with the most points, or the article or main part around it,
    is kept whole, with all siblings of which less than half stands in links; only parts that are never main text are
    left out.
    """
    if not page:
        return ""
    tree = parse(page)
    n = len(tree.tags)
    points, sizes, links = [0.0] * n, [0] * n, [0] * n
    kept = [b for b in tree.blocks if tree.outside[b[0]] == 0 or tree.outside[b[0]] == 2 and tree.tags[b[0]] in HEADINGS]
    if not kept:
        return ""
    for owner, text, linked in kept:
        sizes[owner] += len(text)
        links[owner] += linked
        tag = tree.tags[owner]
        if tag in HEADINGS:
            continue
        gain = _points(text)
        # Text that stands directly in a container is a paragraph of it.
        parent = owner if tag not in ("p", "li", "td", "th", "dd", "dt", "pre", "blockquote", "figcaption") else tree.parents[owner]
        points[max(0, parent)] += gain
        if parent > 0:
            points[tree.parents[parent]] += gain / 2
    for i in range(n - 1, 0, -1):
        sizes[tree.parents[i]] += sizes[i]
        links[tree.parents[i]] += links[i]
    scores = [p * (1 - links[i] / sizes[i]) if sizes[i] and not tree.outside[i] else 0.0 for i, p in enumerate(points)]
    best = max(range(n), key=lambda i: (scores[i], -i))
    if scores[best] <= 0:
        best = kept[0][0]
    top, i = best, best
    while i > 0:
        if tree.tags[i] == "article" or tree.tags[i] == "main" and tree.tags[top] != "article":
            top = i
        i = tree.parents[i]
    # A sibling stands by its own text, whatever its length: kept unless most of it is in links.
    roots = {top}
    for i in range(1, n):
        beside = top and tree.parents[i] == tree.parents[top] and tree.outside[i] != 1
        if beside and sizes[i] and 2 * links[i] < sizes[i]:
            roots.add(i)
    # Text that stands directly in the parent, between the siblings, is a sibling too.
    around = tree.parents[top] if top else -1
    inside = [False] * n
    for i in range(n):
        inside[i] = i in roots or i > 0 and inside[tree.parents[i]]
    return "\n".join(
        text for owner, text, linked in kept if inside[owner] or owner == around and 2 * linked < len(text)
    )


def extract_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """The rows without their html, with a column ``name``: the page's main text.

    Whole pages are read. Null, empty and text-free pages give an empty text. A column called ``name`` is replaced, all
    others are kept.
    """
    reach_workers(pages.sparkSession)
    others = [f for f in pages.schema.fields if f.name not in (html, name)]
    frame = pages.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{html}`").alias("_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(others)):
            texts = [main_text(p) for p in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*[f.name for f in others], name])

    return frame.mapInArrow(run, T.StructType([*others, T.StructField(name, T.StringType())]))
