"""A small HTML parser to trees of elements, made for speed and for markup that is not well formed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What a start tag ends when it is the innermost open element of its kind, up to the elements that hold it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ENDS_P = BLOCK - {"br", "button", "option", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head"}
_HOLDS_P = {"article", "aside", "body", "blockquote", "button", "div", "dd", "fieldset", "figure", "footer", "form", "header", "html", "li", "main", "nav", "section", "table", "td", "th"}
#: Elements nested deeper than this are taken as children of the one at this depth; no text is lost.
DEEPEST = 150


class Element:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, *names: str) -> str:
        """The values of attributes, joined by spaces; '' for what is absent."""
        if not self.attributes.strip(" /"):
            return ""
        found = {k.lower(): unescape(v.strip("\"'")) if v else "" for k, v in _ATTRIBUTE.findall(self.attributes)}
        return " ".join(found[n] for n in names if found.get(n))

    def has(self, name: str) -> bool:
        return name in self.attributes and any(k.lower() == name for k, _ in _ATTRIBUTE.findall(self.attributes))

    def walk(self) -> Iterator[Element]:
        """This element and all below, in page order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]


class _Tags:
    """Where the tags of a page end, in time proportional to its length whatever its quotes."""

    def __init__(self, html: str):
        self.html, self.last, self.hopeless = html, html.rfind(">"), set()

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; quoted ones don't. Where a quote is not closed, it is the next one; -1 for none.

        Places behind closing quotes from which no end was found are remembered, so that no run of quotes is gone through twice.
        """
        if at > self.last:
            return -1
        place, passed = at, []
        while (m := _STOP.search(self.html, place)) is not None:
            if m[0] == ">":
                return m.start()
            close = self.html.find(m[0], m.end())
            place = close + 1
            if close < 0 or place in self.hopeless:
                break
            passed.append(place)
        self.hopeless.update(passed)
        return self.html.find(">", at)


def parse(html: str) -> Element:
    """The tree of a page under an element of no name. Comments, declarations and the content of scripts and the like are left out; character references are decoded."""
    root, tags = Element(""), _Tags(html)
    stack, at, text = [root], 0, 0
    lowered = None
    while (at := html.find("<", at)) >= 0:
        follows = html[at + 1 : at + 2]
        closing = follows == "/"
        if follows in ("!", "?"):
            if html.startswith("<!--", at):
                end, width = html.find("-->", at + 4), 3
            elif html.startswith("<![CDATA[", at):
                end, width = html.find("]]>", at + 9), 3
            else:
                end, width = html.find(">", at), 1
            after = len(html) if end < 0 else end + width
            _add_text(stack[-1], html[text:at])
            at = text = after
            continue
        m = _NAME.match(html, at + 1 + closing)
        end = tags.end(m.end()) if m else -1
        if end < 0:  # not a tag: the sign is text
            at += 1
            continue
        _add_text(stack[-1], html[text:at])
        tag, attributes, at = m[0].lower(), html[m.end() : end], end + 1
        text = at
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _ENDS_P:
            _close(stack, {"p"}, _HOLDS_P)
        if tag in _ENDS:
            _close(stack, *_ENDS[tag])
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        if tag in RAW:
            if lowered is None:
                lowered = html.lower() if html.isascii() else re.sub("[A-Z]+", lambda x: x[0].lower(), html)
            close = lowered.find(f"</{tag}", at)
            at = text = len(html) if close < 0 else close
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK) and len(stack) < DEEPEST:
            stack.append(element)
    _add_text(stack[-1], html[text:])
    return root


def _add_text(element: Element, text: str) -> None:
    if text:
        element.children.append(unescape(text) if "&" in text else text)


def _close(stack: list[Element], tags: set[str], until: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in until:
            return
