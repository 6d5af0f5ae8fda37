"""Mark-up of captured pages: scripts told from their strings, and pages as trees in arrays."""

from __future__ import annotations

import html
import re
from itertools import accumulate

# Scripts over this many characters stay where ``isolated`` is not told otherwise, and containers are nested this deep.
SCRIPT_REACH, DEPTH = 65536, 48
#: Nothing is nested deeper than this; it keeps the work on a page in proportion to its size.
ALL_DEPTH = 4 * DEPTH

_OPENING = re.compile(r"<script\b[^>]*>", re.I)
_CLOSING = re.compile(r"</script\s*>", re.I)
#: The pieces of a script. A string or a regular expression without its end is ``open``; mark-up outside of both is no script.
_SCRIPT = re.compile(
    r"""(?P<end></script\s*>)|(?P<note>(?://|<!--)(?:(?!</script\s*>)[^\r\n])*|/\*(?:(?!\*/|</script\s*>).)*+(?:\*/)?)
    |(?P<string>"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|`(?:\\.|[^`\\])*+`)|(?P<open>["'`])|(?P<markup></?[a-z][a-z0-9:-]*(?:\s|/?>))
    |(?P<slash>/)|(?P<word>[\w$]+)|(?P<space>\s+)|(?P<mark>.)""",
    re.S | re.I | re.X,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\r\n])*+\]|[^/\\\[\r\n])*+/", re.S)
#: What a slash may follow to begin a regular expression, and what may follow a string that a script goes on from.
_BEFORE_REGEX = {"", "=", ":", "(", ",", "[", "!", "?", ";", "{", "return", "throw", "case"}
_GOES_ON = re.compile(r"\s*(?:[+),;]|\Z)")


def script_end(raw: str, start: int, known: dict | None = None) -> int | None:
    """Where a script that begins at start ends if its first closing tag stands in one of its strings; None if it does not, or if that is not certain.

    It does where that string is closed and the script goes on from it, and where another
    closing tag follows outside of strings. Closing tags in comments count, as for browsers.
    Scripts are followed to the end of the page; ``known`` keeps for a page, about every 64
    characters, where walks end that come by, so that scripts over the same text read it once.
    """
    first = _CLOSING.search(raw, start)
    at, last, before, held, end, known, passed = start, start, "", False, None, {} if known is None else known, []
    while first and at < len(raw):
        if at > first.start():
            if not held:
                break
            if at >> 6 > last >> 6:
                place = at, before in _BEFORE_REGEX
                if place in known:
                    end = known[place]
                    break
                passed.append(place)
        m = _SCRIPT.match(raw, at)
        kind, stop = m.lastgroup, m.end()
        if kind == "end":
            end = stop if held else None
            break
        if kind in ("open", "markup"):
            break
        if kind == "slash" and before in _BEFORE_REGEX:
            found = _REGEX.match(raw, at)
            if not found:
                break
            stop, before = found.end(), "value"
        elif kind == "string":
            if at < first.start() < stop:
                held = bool(_GOES_ON.match(raw, stop))
            before = "value"
        elif kind in ("slash", "word", "mark"):
            before = m[0]
        at, last = stop, at
    known.update(dict.fromkeys(passed, end))
    return end


def isolated(raw: str, longest: int | None = SCRIPT_REACH) -> tuple[str, int]:
    """The mark-up with emptied scripts where a closing tag in a string would have ended them early, and how many these are.

    A script over ``longest`` characters stays; None sets no such bound.
    """
    parts, at, n, known = [], 0, 0, {}
    while opening := _OPENING.search(raw, at):
        closing = _CLOSING.search(raw, opening.end())
        if not closing:
            break
        end = script_end(raw, opening.end(), known)
        if end and longest is not None and end > opening.end() + longest:
            end = None
        parts.append(raw[at : opening.start()] + "<script></script>" if end else raw[at : closing.end()])
        at, n = end or closing.end(), n + bool(end)
    return "".join([*parts, raw[at:]]), n


# Element names of the HTML standard.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style template textarea title iframe svg math canvas object audio video select".split())
BLOCK = set(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes noscript ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements that stay however deep they stand.
_KEPT = set("table tr td th thead tbody tfoot a img pre code kbd samp br hr input".split())
#: An element ends the nearest open one of the first set, if none of the second stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
} | {name: ({"thead", "tbody", "tfoot"}, {"table"}) for name in ("thead", "tbody", "tfoot")}
_P_WALLS = {"td", "th", "table", "blockquote", "div", "li", "body", "section", "article"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<raw>%s)\b(?P<given>[^>]*)>(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|\Z))|</(?P<close>[a-z][^\s/>]*)[^>]*(?:>|\Z)
    |<(?P<open>[a-z][^\s/>]*)(?:(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<broken>[^>]*)(?:>|\Z))|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)"""
    % "|".join(sorted(RAW)),
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Tree:
    """A page's elements and texts in the order of the page, in arrays; the nodes below i are those up to end[i].

    Broken mark-up gives some tree: an end tag without a start is ignored, one with a start
    ends all that is open in it, list items, cells and paragraphs end their like, and what
    is open at the end ends there. Containers below DEPTH leave a break in their place.
    The fallback inside ``noframes`` and ``noscript`` is mark-up like any other.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.data = [""], [0], [0], [""]
        stack, skipped = [0], []
        for m in _TOKEN.finditer(source):
            kind = m.lastgroup
            if m["text"] is not None:
                self._add("#", stack[-1], html.unescape(m["text"]))
            elif m["raw"]:
                self._add(m["raw"].lower(), stack[-1], m["given"])
            elif m["close"]:
                name = m["close"].lower()
                if name in skipped:
                    while skipped.pop() != name:
                        pass
                    self._add("break", stack[-1], "")
                elif k := next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name), 0):
                    self._close(stack, k)
            elif m["open"] and kind:
                name, attrs = m["open"].lower(), m["attrs"] if m["attrs"] is not None else m["broken"]
                self._imply(stack, name)
                if len(stack) > (ALL_DEPTH if name in _KEPT else DEPTH) and name not in VOID:
                    skipped.append(name)
                    if name in BLOCK:
                        self._add("break", stack[-1], "")
                    continue
                node = self._add(name, stack[-1], attrs)
                if name not in VOID and not attrs.endswith("/"):
                    stack.append(node)
        self._close(stack, 0)

    def _add(self, tag: str, parent: int, data: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.data.append(data)
        self.end.append(len(self.tag))
        return len(self.tag) - 1

    def _close(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.end[node] = len(self.tag)
        del stack[k:]

    def _imply(self, stack: list[int], name: str) -> None:
        targets, walls = _ENDS.get(name, ({"p"}, _P_WALLS) if name in BLOCK else ((), ()))
        for k in range(len(stack) - 1, 0, -1) if targets else ():
            tag = self.tag[stack[k]]
            if tag in targets:
                return self._close(stack, k)
            if tag in walls:
                return None

    def attribute(self, node: int, name: str) -> str | None:
        """An attribute's value, '' where it has none, None where it is not given."""
        for m in _ATTRIBUTE.finditer(self.data[node]):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def within(self, node: int, tags: set[str]) -> list[int]:
        return [k for k in range(node + 1, self.end[node]) if self.tag[k] in tags]

    def words(self, node: int) -> str:
        """The text below a node, white space as one space."""
        return " ".join(" ".join(self.data[k] for k in range(node, self.end[node]) if self.tag[k] == "#").split())

    def above(self, node: int) -> list[int]:
        out = []
        while node:
            node = self.parent[node]
            out.append(node)
        return out

    def owners(self, tag: str) -> list[int]:
        """For each node, the nearest element of a name that it stands in, 0 if there is none."""
        out = [0] * len(self.tag)
        for k in range(1, len(self.tag)):
            out[k] = self.parent[k] if self.tag[self.parent[k]] == tag else out[self.parent[k]]
        return out

    def inked(self) -> list[int]:
        """How many nodes before each are images or have visible text."""
        return [0, *accumulate(int(t == "img" or t == "#" and not d.isspace() and d != "") for t, d in zip(self.tag, self.data))]
