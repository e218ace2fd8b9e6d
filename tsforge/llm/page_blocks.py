"""Pages as streams of tags and text blocks.

A block is the text between two block-level tags; inline tags do not end it. Every open element has a role, the path of tags
and class names that lead to it. Tags left open are closed where HTML says so; scripts, styles and comments are no text.
"""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr picture q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var".split())
#: Elements whose text is never read; those in the line do not end a block.
UNREAD = frozenset("head noscript template object audio video map datalist dialog nav footer aside form menu fieldset".split())
UNREAD_IN_LINE = frozenset("button select option optgroup label output progress meter svg math canvas script style iframe textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: An open element on the left ends when one on the right begins, inside the same element of the last column.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
         "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tbody": ("thead tbody tfoot tr td th", ("table",)),
         "tfoot": ("thead tbody tfoot tr td th", ("table",))}
_ENDS = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _ENDS.items()}

#: Words of class, id and role that mark what surrounds an article.
SURROUNDINGS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner banners cookie cookies "
    "consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside menu menus nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar footer footers comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations widget widgets copyright search contentinfo complementary".split())
HEADERS = frozenset("header headers masthead".split())

BOILER, ARTICLE, MAIN, HEADER = 1, 2, 4, 8

_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)
    |<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>{_ATTRS})>
    |<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*+)>
    |<[!?/][^>]*+(?:>|\Z)|<[a-z][^>]*+\Z""", re.S | re.I | re.X)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORTH = re.compile(r"class|id|role|itemprop|hidden", re.I)


class Block(NamedTuple):
    text: str
    flags: int
    token: int
    linked: int


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little") >> 1 or 1


class _Element(NamedTuple):
    key: bytes
    boiler: bool
    header: bool
    main: int


_elements: dict[tuple[str, str], _Element] = {}
_roles: dict[tuple[int, bytes], int] = {}


def _element(name: str, attrs: str) -> _Element:
    """What a tag's name and attributes say."""
    got = _elements.get((name, attrs))
    if got is None:
        if len(_elements) > 20_000:
            _elements.clear()
        words, key, main, hidden = set(), [name], 0, False
        for m in _NAMED.finditer(attrs) if _WORTH.search(attrs) else ():
            what, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if what == "hidden" or (what == "aria-hidden" and value.lower() == "true"):
                hidden = True
            elif what == "itemprop":
                main |= ARTICLE if value.lower() == "articlebody" else 0
            else:
                if what == "role" and value.lower() == "main":
                    main |= MAIN
                for part in value.split():
                    if not re.match(r"(?:no|has|with|without)[-_]", part, re.I):
                        words.update(w.lower() for w in _PARTS.findall(part))
                    key.append(re.sub(r"\d+", "", part))
        main |= ARTICLE if name == "article" else MAIN if name == "main" else 0
        whole = name in ("html", "body", "main")
        boiler = hidden or name in UNREAD or name in UNREAD_IN_LINE or (not whole and not words.isdisjoint(SURROUNDINGS))
        header = not whole and (name == "header" or not words.isdisjoint(HEADERS))
        got = _elements[name, attrs] = _Element(" ".join(key).encode(), boiler, header, main)
    return got


def _role(parent: int, key: bytes) -> int:
    got = _roles.get((parent, key))
    if got is None:
        if len(_roles) > 100_000:
            _roles.clear()
        got = _roles[parent, key] = _hash(parent.to_bytes(8, "little"), key)
    return got


def read_page(page: str) -> tuple[list[Block], list[int]]:
    """(blocks, tokens): the text blocks in page order, and the roles of opened elements and the blocks' tokens in that order."""
    blocks, tokens = [], []
    stack = [("", 0, 0, False)]  # name, role, flags, in line and unread
    held, linked, in_link = [], 0, False

    def text(piece):
        nonlocal linked
        if stack[-1][3]:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        held.append(piece)
        if in_link:
            linked += len(piece)

    def flush():
        nonlocal linked
        if held:
            whole = " ".join("".join(held).split())
            held.clear()
            if whole:
                _, role, flags, _ = stack[-1]
                token = _hash(role.to_bytes(8, "little"), whole.encode("utf-8", "surrogatepass"))
                blocks.append(Block(whole, flags, token, linked))
                tokens.append(token)
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if name == "a":
                in_link = False
            depth = len(stack) - 1
            while depth and stack[depth][0] != name:
                depth -= 1
            if depth:
                if not all(e[3] for e in stack[depth:]):
                    flush()
                del stack[depth:]
            elif name == "p" or (name not in INLINE and name not in VOID and name not in UNREAD_IN_LINE):
                flush()
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            elif name == "hr":
                flush()
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        in_line = name in INLINE or name in UNREAD_IN_LINE
        if name == "a":
            in_link = True
        if in_line:
            if (name in UNREAD_IN_LINE or _WORTH.search(attrs)) and not attrs.endswith("/"):
                element = _element(name, attrs)
                if element.boiler:
                    stack.append((name, stack[-1][1], stack[-1][2] | BOILER, True))
            continue
        if name == "html" or (name == "body" and any(e[0] == "body" for e in stack)):
            continue
        flush()
        if stack[-1][0] == "head" and name not in _IN_HEAD:
            stack.pop()
        if stack[-1][0] == "p":
            stack.pop()
        if name in _ENDS:
            closes, within = _ENDS[name]
            depth = len(stack) - 1
            while depth and stack[depth][0] not in within:
                if stack[depth][0] in closes:
                    del stack[depth:]
                depth -= 1
        element = _element(name, attrs)
        _, role, flags, _ = stack[-1]
        if element.boiler or (name == "article" and flags & ARTICLE):  # an article in an article is a comment
            flags |= BOILER
        elif element.header:
            flags |= HEADER if flags & (ARTICLE | MAIN) else BOILER
        elif name in HEADINGS:
            flags &= ~HEADER
        flags |= element.main
        role = _role(role, element.key)
        stack.append((name, role, flags, False))
        tokens.append(role)
    if at < len(page):
        text(page[at:])
    flush()
    return blocks, tokens
