"""CSS selectors over a page as it is parsed: types, classes, ids, attributes, positions, descendants, children, alternatives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_NAME = r"(?:[\w-]|[^\x00-\x7F])+"
_PART = re.compile(
    rf"""(?P<tag>{_NAME}|\*)|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})|:(?P<first>first-child)|:nth-child\(\s*(?P<nth>\d+)\s*\)
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>{_NAME}))\s*)?\]""",
    re.X,
)
_COMPARE = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want),
    "*=": lambda have, want: want != "" and want in have,
}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    #: Its number among the elements of its parent, from 1, and how many it has seen itself.
    place: int
    children: int = 0
    row: dict | None = None
    sinks: list[list[str]] = field(default_factory=list)


def _compound(text: str) -> list[dict]:
    parts, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"can't read the selector {text!r} at {text[at:]!r}")
        parts.append({k: v for k, v in m.groupdict().items() if v is not None})
        at = m.end()
    return parts


def parse(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Alternatives, each a list of (combinator before it, compound), the last one first. What isn't understood is an error."""
    out = []
    quoted = r"""\[[^\]]*\]|\([^)]*\)"""
    listed = re.findall(rf"(?:{quoted}|[^,\[(])+|,", selector.strip())
    # commas and selectors take turns, and nothing is left over, such as an open bracket
    if "".join(listed) != selector.strip() or len(listed) % 2 == 0 or any((one == ",") != (i % 2 == 1) for i, one in enumerate(listed)):
        raise ValueError(f"{selector!r} isn't a selector")
    for one in listed[::2]:
        steps = re.findall(rf"(?:{quoted}|[^\s>\[(])+|>", one)
        chain, joined = [], ""
        for step in steps:
            if step == ">":
                if joined == ">" or not chain:
                    raise ValueError(f"a compound is missing beside > in {selector!r}")
                joined = ">"
            else:
                chain.append((joined, _compound(step)))
                joined = " "
        if not chain or joined == ">":
            raise ValueError(f"{selector!r} isn't a selector")
        out.append(chain[::-1])
    return out


def _is(e: Element, compound: list[dict]) -> bool:
    for p in compound:
        if "tag" in p and p["tag"] not in ("*", e.tag) and p["tag"].lower() != e.tag:
            return False
        if "cls" in p and p["cls"] not in e.attrs.get("class", "").split():
            return False
        if "id" in p and e.attrs.get("id") != p["id"]:
            return False
        if ("first" in p and e.place != 1) or ("nth" in p and e.place != int(p["nth"])):
            return False
        if "attr" in p:
            have = e.attrs.get(p["attr"].lower())
            want = next((p[k] for k in ("double", "single", "bare") if k in p), "")
            if have is None or ("op" in p and not _COMPARE[p["op"]](have, want)):
                return False
    return True


def _chain(stack: list[Element], chain: list[tuple[str, list[dict]]]) -> bool:
    """Whether the innermost element fits; ancestors are tried from the inside."""
    if not stack or not _is(stack[-1], chain[0][1]):
        return False
    if len(chain) == 1:
        return True
    above = range(len(stack) - 1, 0, -1) if chain[0][0] == " " else [len(stack) - 1]
    return any(_chain(stack[:i], chain[1:]) for i in above)


class Rows(HTMLParser):
    """The elements that fit a row's selector, and in each the text of the first element that fits each field's."""

    def __init__(self, row: str, **fields: str):
        super().__init__(convert_charrefs=True)
        self.row, self.fields = parse(row), {k: parse(s) for k, s in fields.items()}
        self.stack = [Element("", {}, 1)]
        self.rows: list[dict[str, list[str]]] = []

    def _fits(self, alternatives: list) -> bool:
        return any(_chain(self.stack[1:], c) for c in alternatives)

    def handle_starttag(self, tag, attrs):
        parent = self.stack[-1]
        parent.children += 1
        e = Element(tag, {k: v or "" for k, v in attrs}, parent.children)
        open_rows = [x.row for x in self.stack if x.row is not None]
        self.stack.append(e)
        for name, selector in self.fields.items():
            wanting = [r for r in open_rows if name not in r]
            if wanting and self._fits(selector):
                for r in wanting:
                    r[name] = []
                    e.sinks.append(r[name])
        if self._fits(self.row):
            e.row = {}
            self.rows.append(e.row)
        if tag in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        for e in self.stack:
            for sink in e.sinks:
                sink.append(data)
