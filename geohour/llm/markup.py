"""Tags of a web page in one pass: time grows with the page, whatever it holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# Elements whose content is no markup and no text of the page.
RAW = ("script", "style", "noscript", "template", "svg", "textarea")
_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_SPECIAL = re.compile(r"""[>"']""")
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


@dataclass
class Tag:
    """A tag, a comment or a raw element with its content; `name` is empty for what is no tag."""

    start: int
    end: int
    name: str = ""
    closing: bool = False
    attributes: str = ""


class _Ends:
    """Where tags end: at the first `>` outside quoted values.

    A quote opens a value only behind `=`, and only if it is closed again; else it is a character
    like others. Quotes and `>` are listed once. A walk over them that ends without a `>` marks
    the places that it came by, and later walks stop there, so all walks together are linear.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.at = [m.start() for m in _SPECIAL.finditer(page)]
        self.next_same = [len(self.at)] * len(self.at)  # the next quote of the same kind
        latest: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            self.next_same[i] = latest.get(c, len(self.at))
            latest[c] = i
        self.lost = bytearray(len(self.at) + 1)
        self.lost[-1] = 1
        self.last = page.rfind(">")
        self.first = 0  # of the list, not before the place last asked for

    def end(self, start: int) -> int:
        """The place behind the tag that begins at `start`, or -1; places are asked for in order."""
        while self.first < len(self.at) and self.at[self.first] < start:
            self.first += 1
        i, seen = self.first, []
        while not self.lost[i]:
            at = self.at[i]
            if self.page[at] == ">":
                return at + 1
            seen.append(i)
            opens = self.next_same[i] < len(self.at) and self._behind_equals(at)
            i = self.next_same[i] + 1 if opens else i + 1
        for i in seen:
            self.lost[i] = 1
        return self.any_end(start)  # none outside quotes: the first one inside them must do

    def any_end(self, start: int) -> int:
        """The place behind the next `>`, or -1."""
        return self.page.find(">", start) + 1 if start <= self.last else -1

    def _behind_equals(self, at: int) -> bool:
        at -= 1
        while at >= 0 and self.page[at].isspace():
            at -= 1
        return at >= 0 and self.page[at] == "="


def tags(page: str, raw: tuple[str, ...] = RAW) -> Iterator[Tag]:
    """All tags in order. What lies between them is text; `<` that begins no tag is text too.

    Comments and raw elements end at their end or with the page; a tag without an end is text.
    """
    ends = _Ends(page)
    at = page.find("<")
    while at >= 0:
        to = at + 1
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            to = close + 3 if close >= 0 else len(page)
            yield Tag(at, to)
        elif page[to:to + 1] in ("!", "?"):
            close = ends.any_end(to)
            if close >= 0:
                to = close
                yield Tag(at, to)
        else:
            closing = page[to:to + 1] == "/"
            name = _NAME.match(page, to + closing)
            close = ends.end(name.end()) if name else -1
            if close >= 0:
                tag = Tag(at, close, name.group().lower(), closing, page[name.end():close - 1])
                if not closing and tag.name in raw:
                    found = _RAW_END[tag.name].search(page, close)
                    if found is None:
                        close = len(page)
                    else:
                        close = page.find(">", found.end() - 1) + 1 or len(page)
                    tag = Tag(at, close)
                to = close
                yield tag
        at = page.find("<", to)
