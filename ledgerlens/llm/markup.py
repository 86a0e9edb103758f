"""HTML as a sequence of tags and text blocks."""

from __future__ import annotations

import html
import re

#: The inside of a tag. A quote opens a value only right after an equals sign.
_REST = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
#: Comments, elements whose content is no text, other tags, text. An unclosed comment, script or tag runs to the end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<dead>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|title|select)\b(?P<inner>" + _REST + r")(?:>(?:(?<=/>)|.*?(?:</(?P=dead)\s*>|\Z))|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>" + _REST + r")(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand inside a block; all others end it.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())


def attributes(rest: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(rest)} if rest else {}


def tokens(page: str):
    """Yield (kind, name, rest): kind is 'open', 'close', 'text' (name is the text) or 'dead' (skipped elements)."""
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", m["text"], ""
        elif m["name"]:
            yield "close" if m["close"] else "open", m["name"].lower(), m["rest"] or ""
        elif m["dead"]:
            yield "dead", m["dead"].lower(), ""


def tidy(parts: list[str]) -> str:
    """Character references decoded, white space to single spaces, trimmed."""
    return " ".join(html.unescape("".join(parts)).split())


def plain_text(page: str | None) -> list[str]:
    """All text blocks in page order; scripts, styles, titles and the like are no text."""
    blocks, now = [], []
    for kind, name, _ in tokens(page or ""):
        if kind == "text":
            now.append(name)
        elif kind == "dead" or name == "br":
            now.append(" ")
        elif name not in INLINE:
            blocks.append(now)
            now = []
    return [x for x in map(tidy, [*blocks, now]) if x]
