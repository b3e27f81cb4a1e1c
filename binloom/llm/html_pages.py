"""Pages as streams of elements and text, and the boilerplate that markup itself names."""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

# Fixed values of HTML: which elements are void, raw, inline or end an open paragraph, and what an element ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Elements that are never article text.
ASIDE = set("head nav footer aside form button select script style noscript template iframe svg canvas object textarea title dialog menu".split())
#: Words of a class, id or role that name menus, footers, sidebars, notices, adverts, forms and reader comments.
NAMED = set(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup comment comments reply replies respond disqus discussion share sharing social related recommended login search toolbar pagination pager skip contentinfo complementary".split()
)
#: Of page headers, as long as they aren't part of the article.
HEADERS = {"header", "masthead", "topbar"}
#: Words before a name that say what surrounds an element, not what it is.
ABOUT = {"with", "has", "no", "without", "after", "before"}
#: Names of containers of article text: the element itself, and others by their class, id, role or itemprop.
BODIES = {"article-body", "article-content", "article-text", "articlebody", "post-content", "post-body", "entry-content", "story-body", "main-content", "maincontent"}
CONTENT = {"content", "main", "post", "entry", "story", "article"}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>", re.S)
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that hold a passage, not an article.
PASSAGES = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre figure figcaption address details summary tr tbody thead tfoot".split())
#: Elements nested deeper count as part of their ancestor.
DEPTH = 200
#: The key of a run of text among an element's children.
TEXT = "#"


class Block(NamedTuple):
    slot: int
    level: int
    holders: tuple[int, ...]  # the ancestors that may hold an article
    ancestors: tuple[int, ...]
    text: str
    linked: int  # letters inside links


class Element(NamedTuple):
    tag: str
    path: int
    holders: tuple[int, ...]
    ancestors: tuple[int, ...]
    dropped: bool
    level: int
    children: list[str]


def path_of(parent: int, key: str, known: dict[tuple[int, str], int]) -> int:
    """A number for the place of a child with this key: the same on all pages."""
    found = known.get((parent, key))
    if found is None:
        if len(known) > 1 << 16:
            known.clear()
        found = known[parent, key] = int.from_bytes(hashlib.blake2b(f"{parent}/{key}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
    return found


def _described(tag: str, attributes: str) -> tuple[str, list[list[str]], set[str]]:
    """Key, the words of each name, and the whole names of an element."""
    names = [w for _, a, b, c in NAMES.findall(attributes) for w in (a or b or c).split()]
    whole = {w.lower().replace("_", "-") for w in names}
    plain = sorted(w for w in whole if not re.search(r"\d", w))
    return ".".join([tag, *plain]), [[p.lower() for p in PARTS.findall(w)] for w in names], whole


def _named(words: list[list[str]], among: set[str]) -> bool:
    return any(p in among and not (set(name[:k]) & ABOUT) for name in words for k, p in enumerate(name))


def _entered(tag: str, attributes: str, parent: Element, known: dict) -> tuple[str, Element]:
    key, words, whole = _described(tag, attributes) if attributes else (tag, [], set())
    inner = parent.level > 1
    dropped = parent.dropped or tag in ASIDE or tag == "header" and not inner
    if not dropped and words and tag not in ("html", "body", "main"):
        dropped = _named(words, NAMED) or not inner and _named(words, HEADERS)
    level = parent.level
    if tag == "article":
        level = 3
    elif tag == "main" or whole & BODIES or "main" in whole and "role" in attributes.lower():
        level = max(level, 2)
    elif tag not in ("html", "body") and whole & CONTENT:
        level = max(level, 1)
    if len(parent.ancestors) >= DEPTH:
        return key, Element(tag, parent.path, parent.holders, parent.ancestors, dropped, level, parent.children)
    path = path_of(parent.path, key, known)
    holders = parent.holders if tag in PASSAGES else (*parent.holders, path)
    return key, Element(tag, path, holders, (*parent.ancestors, path), dropped, level, [])


def parsed(page: str, known: dict[tuple[int, str], int], structure: dict[int, set[tuple[str, ...]]] | None = None) -> list[Block]:
    """The blocks of text that may be the article's, in page order; what each place has as children is added to structure.

    White space in a block is one space.  Inline markup is part of its block unless its class names boilerplate.
    Elements that are left open end with their ancestors.
    """
    root = Element("", 0, (0,), (), False, 0, [])
    stack, blocks, run, links, linked = [root], [], [], 0, 0

    def ended_text() -> None:
        nonlocal linked
        if run:
            at, text = stack[-1], " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                at.children.append(TEXT)
                if not at.dropped:
                    blocks.append(Block(path_of(at.path, TEXT, known), at.level, at.holders, at.ancestors, text, min(linked, len(text))))
        linked = 0

    def left(to: int) -> None:
        ended_text()
        while len(stack) > to:
            gone = stack.pop()
            if structure is not None and gone.children is not stack[-1].children:
                structure.setdefault(gone.path, set()).add(tuple(gone.children))

    def ended(tags: set[str], inside: set[str]) -> None:
        """Leaves the outermost open element of these tags within the nearest of `inside`."""
        to = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in inside:
                break
            if stack[k].tag in tags:
                to = k
        if to is not None:
            left(to)

    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        said = page[at : m.start() if m else len(page)]
        if said:
            run.append(said)
            linked += len(said) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            run.append("\n")
        elif closing:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                left(k)
            elif tag not in INLINE:
                ended_text()
        elif tag in INLINE:
            if "=" in attributes and _named(_described(tag, attributes)[1], NAMED):
                ended_text()
                key, element = _entered(tag, attributes, stack[-1], known)
                if element.children is not stack[-1].children:
                    stack[-1].children.append(key)
                stack.append(element)
        elif tag in VOID:
            if tag == "hr":
                ended_text()
        else:
            ended_text()
            if tag in ENDS:
                ended(ENDS[tag], WITHIN[tag])
            else:
                ended({"p"}, {"td", "th", "li", "button", "object"})
            key, element = _entered(tag, attributes, stack[-1], known)
            if element.children is not stack[-1].children:
                stack[-1].children.append(key)
            stack.append(element)
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
                if end and end.start() > at or not end and at < len(page):
                    element.children.append(TEXT)
                at = end.start() if end else len(page)
    left(1)
    if structure is not None:
        structure.setdefault(0, set()).add(tuple(root.children))
    return blocks
