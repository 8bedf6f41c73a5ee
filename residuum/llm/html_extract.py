"""Layout-aware text of web pages.

A scanner yields tags and text; a tree builder closes what HTML lets authors
leave open (paragraphs, list items, cells, rows) and drops stray end tags; a
renderer walks the tree and writes all visible text. Hidden are elements that
browsers do not show (head matter, scripts, templates, closed dialogs), ``hidden``
attributes, ``display:none``, and closed ``details`` apart from their summary;
``visibility:hidden`` hides text down to where it is set visible again. Styles come
from ``style`` attributes and from the rules of ``style`` elements, in the order of the
cascade: selectors of tags, classes, identifiers and attributes, ``:not``, first, last and only
children, with all combinators (rules with other pseudo-classes are not looked at). Conditions
on media are weighed for a desktop screen, :data:`VIEWPORT`. Block elements start
new lines, paragraphs and headings are set apart by an empty line, list items get
bullets or numbers with indentation, and the cells of a table, spans over columns
and rows included, are padded to common column widths; cells of over 80 characters are
wrapped at spaces. Formulas, labels of drawings and buttons, all options of choices and the
contents of text areas are text.

Elements may be nested to any depth. Inside 50 quotes and list items indentation stops
growing; tables, lists and lines go on.

Null or empty pages give an empty text. Pages of any length are read whole. Repeated rows and null
identifiers are rendered like others; an empty table gives an empty result;
extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from heapq import heappop, heappush
from html import unescape
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from residuum.llm.common import map_batches

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe object embed audio video canvas "
    "datalist noembed noframes meta link base param source track area".split()
)
#: Inside svg and math: elements that show nothing, HTML that ends the drawing, and elements that hold HTML.
UNDRAWN = {"svg": frozenset("desc metadata defs symbol clippath mask marker pattern".split()), "math": frozenset(["annotation", "annotation-xml"])}
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = {"svg": frozenset(["foreignobject"]), "math": frozenset("mi mo mn ms mtext".split())}
#: Elements set apart from their neighbours by a space.
APART = frozenset("td th option optgroup mtd mtr mfrac text".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table "
    "ul caption tr".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dir dl table figure hr".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag that ends an open element, up to a boundary: tag -> (ended, boundaries).
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # of one cell
CLOSES_P = BLOCK - {"html", "body", "caption", "tr", "legend"}
_SCOPE = frozenset("table td th caption button template html foreignobject".split())

# As the HTML tokenizer does: a quote opens a string only directly after "=", and a tag ends at the
# next ">" elsewhere. Possessive, so linear. A tag that the page's end cuts off is dropped.
_PAIR = r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?+)?+"
_PAIRS = "((?:[\\s/]++|" + re.sub(r"\((?=\[)", "(?:", _PAIR) + ")*+)"
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*+)" + re.sub(r"^\(", "(?:", _PAIRS) + r"(?:>|\Z)|"
    r"<([a-zA-Z][^\s/>]*+)" + _PAIRS + r"(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(_PAIR)
_DECLARATION = re.compile(r"(?:\A|;)\s*+(display|visibility)\s*+:\s*+([a-z-]++)\s*+(!\s*+important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_LAST = re.compile(r"[^\s\"'>]*+")  # of a reversed text
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    #: ``space``: "" for HTML, "math", "svg" where text is not drawn, "label" in a text of a drawing, "none" if unseen
    #: ``up``, ``number``, ``siblings``: the parent, and the place among its elements
    __slots__ = ("tag", "attrs", "children", "space", "shown", "up", "number", "siblings", "_marks")

    def __init__(self, tag: str, attrs: dict[str, str], space: str = ""):
        self.tag, self.attrs, self.children, self.space, self.shown = tag, attrs, [], space, True
        self.up, self.number, self.siblings, self._marks = None, 0, [self], None

    def marks(self) -> set[str]:
        """Classes and identifier, as selectors write them."""
        if self._marks is None:
            self._marks = {"." + c for c in self.attrs.get("class", "").split()} | ({"#" + self.attrs["id"]} if "id" in self.attrs else set())
        return self._marks

    def before(self) -> Node | None:
        return self.siblings[self.number - 1] if self.number else None

    def at(self, place: str) -> bool:
        if place == "root":
            return self.up is None
        if place == "empty":
            return not any(isinstance(c, Node) or c for c in self.children)
        return (place == "last-child" or self.number == 0) and (place == "first-child" or self.number == len(self.siblings) - 1)

    def label(self) -> str:
        """What a button shows."""
        return self.attrs.get("value", "") if self.attrs.get("type", "").lower() in ("submit", "button", "reset") else ""


def _space(tag: str, around: str) -> str:
    if tag in ("svg", "math"):
        return around if around == "none" else tag
    if not around or around == "none":
        return around
    kind = "math" if around == "math" else "svg"
    if tag in UNDRAWN[kind]:
        return "none"
    if tag in HOLDS_HTML[kind]:
        return ""
    return "label" if kind == "svg" and tag == "text" else around


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _ends_in_value(attributes: str) -> bool:
    """The last characters, up to a quote or white space, are or hold the value of an attribute."""
    run = _LAST.match(attributes[::-1])[0]
    return "=" in run[1:] or attributes[: len(attributes) - len(run)].rstrip().endswith("=")


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack = [root]
    opened: defaultdict[str, list[int]] = defaultdict(list)  # where the stack holds a tag, so that nothing is searched

    def cut(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag].pop()
        del stack[i:]

    def last(tags: frozenset) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def close_to(tags: frozenset, boundaries: frozenset) -> None:
        i = last(tags)
        if i > 0 and i >= last(boundaries):
            cut(i)

    def text(value: str) -> None:
        if stack[-1].space != "svg":
            stack[-1].children.append(value)

    def start(tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if tag in BREAKS_OUT:
            while stack[-1].space:
                cut(len(stack) - 1)
        if tag in ("html", "body"):
            root.attrs.update({k: v for k, v in attrs.items() if k not in root.attrs})
            return
        if tag in CLOSES_P:
            close_to(frozenset(["p"]), _SCOPE)
        if tag in ENDS:
            close_to(*ENDS[tag])
        if tag in ("td", "th"):  # implied row
            if last(frozenset(["table"])) > last(frozenset(["tr"])):
                start("tr", {})
        if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
            cut(len(stack) - 1)
        node = Node(tag, attrs, _space(tag, stack[-1].space))
        stack[-1].children.append(node)
        if tag not in VOID and not (closed and (stack[-1].space or node.space)):
            opened[tag].append(len(stack))
            stack.append(node)

    at = 0
    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            text(unescape(html[at:]))
            break
        found = _TOKEN.match(html, mark)
        if found is None:  # a lone "<" is text
            after = html.find("<", mark + 1)
            after = len(html) if after < 0 else after
            text(unescape(html[at:after]))
            at = after
            continue
        if mark > at:
            text(unescape(html[at:mark]))
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if tag in ("html", "body"):
                continue
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p", {}))
                continue
            barrier = _SCOPE - {tag, "html"} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset(["table"]) - {tag}
            close_to(frozenset([tag]), barrier)
        elif found[2]:
            if not found[4]:
                break
            tag = found[2].lower()
            closed = found[3].endswith("/") and not _ends_in_value(found[3])
            start(tag, _attributes(found[3]) if found[3].strip(" /") else {}, closed)
            if tag in RAW and not (closed and stack[-1].space):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                until = end.start() if end else len(html)
                body = html[at:until]
                text(unescape(body) if tag in ("title", "textarea") else body)
                at = until
    return root


#: The window for which media conditions are weighed: a desktop screen.
VIEWPORT = {"width": 1280.0, "height": 800.0, "device-width": 1280.0, "device-height": 800.0}
_UNITS = {"px": 1.0, "em": 16.0, "rem": 16.0, "pt": 4 / 3, "cm": 96 / 2.54, "in": 96.0, "": 1.0}
_TRUE = frozenset([
    ("orientation", "landscape"), ("prefers-color-scheme", "light"), ("prefers-reduced-motion", "no-preference"), ("hover", "hover"), ("pointer", "fine"),
    ("any-hover", "hover"), ("any-pointer", "fine"), ("scripting", "none"), ("color", ""), ("hover", ""), ("width", ""), ("height", ""), ("display-mode", "browser"),
])
_LENGTH = re.compile(r"([0-9.]++)\s*+(px|em|rem|pt|cm|in|)")
_COMPARED = re.compile(r"(?:([0-9.]+\s*[a-z]*)\s*(<=|>=|<|>)\s*)?((?:device-)?(?:width|height))\s*(?:(<=|>=|<|>|=)\s*([0-9.]+\s*[a-z]*))?")


def _pixels(value: str) -> float | None:
    m = _LENGTH.fullmatch(value.strip())
    try:
        return float(m[1]) * _UNITS[m[2]] if m else None
    except ValueError:
        return None


def _compare(a: float | None, sign: str, b: float | None) -> bool:
    if a is None or b is None:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[sign]


def _feature(condition: str) -> bool:
    """One condition in brackets, for a desktop screen; unknown ones do not hold."""
    name, colon, value = (x.strip() for x in condition.partition(":"))
    if not colon:
        m = _COMPARED.fullmatch(name)
        if m and (m[2] or m[4]):
            own = VIEWPORT[m[3]]
            return (not m[2] or _compare(_pixels(m[1]), m[2], own)) and (not m[4] or _compare(own, m[4], _pixels(m[5])))
        return (name, "") in _TRUE
    bound, _, rest = name.partition("-")
    if bound in ("min", "max") and rest in VIEWPORT:
        return _compare(VIEWPORT[rest], ">=" if bound == "min" else "<=", _pixels(value))
    if name in VIEWPORT:
        return _compare(VIEWPORT[name], "=", _pixels(value))
    if rest == "resolution":
        m = re.fullmatch(r"([0-9.]+)(dppx|x|dpi)", value)
        return bool(m) and _compare(1.0, ">=" if bound == "min" else "<=", float(m[1]) / (96 if m[2] == "dpi" else 1))
    return (name, value) in _TRUE


def _for_screens(media: str) -> bool:
    """A list of media queries, of which one holds for a desktop screen."""
    media = media.strip().lower()
    return not media or any(_query(m.strip()) for m in media.split(","))


def _query(query: str) -> bool:
    negated, _, rest = query.partition(" ")
    if negated in ("not", "only"):
        query = rest.strip()
    holds = True
    for part in re.split(r"\s+and\s+|(?<=\))\s*and\s*(?=\()", query):
        part = part.strip()
        if part.startswith("not"):
            holds &= not _either(part[3:].strip())
        elif part.startswith("("):
            holds &= _either(part)
        else:
            holds &= part in ("all", "screen")
    return holds != (negated == "not")


def _either(part: str) -> bool:
    """Conditions in brackets, joined by ``or``; brackets around brackets count for what is in them."""
    return any(_feature(x.strip().strip("()").strip()) for x in re.split(r"\)\s*or\s*\(", part))


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of a style sheet, those of media rules for screens included."""
    css = _COMMENT.sub(" ", css)
    at = 0
    while (brace := css.find("{", at)) >= 0:
        prelude = css[at:brace].replace("}", " ").rsplit(";", 1)[-1].strip()
        if prelude.startswith("@") and not (prelude.lower().startswith("@media") and _for_screens(prelude[6:])):
            depth, at = 1, brace + 1  # skip the block and all inside
            for found in re.compile("[{}]").finditer(css, at):
                depth += 1 if found[0] == "{" else -1
                at = found.end()
                if not depth:
                    break
            else:
                return
            continue
        at = brace + 1
        if not prelude.startswith("@"):
            end = css.find("}", at)
            end = len(css) if end < 0 else end
            yield prelude, css[at:end]
            at = end + 1


_PART = re.compile(r"\s*([>+~]|\s)\s*|([a-z][\w-]*|\*)|([.#][\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]|:not\(\s*([^()]*)\)|:(first-child|last-child|only-child|root|empty)(?![\w(-])", re.I)


class Compound:
    """What a selector says of one element."""

    __slots__ = ("tag", "marks", "attrs", "nots", "places")

    def __init__(self) -> None:
        self.tag, self.marks, self.attrs, self.nots, self.places = "*", set(), [], [], set()

    def matches(self, node: Node) -> bool:
        if self.tag not in ("*", node.tag) or not self.marks <= node.marks():
            return False
        for name, sign, value in self.attrs:
            own = node.attrs.get(name)
            if own is None or not {"": True, "=": own == value, "~=": value in own.split(), "|=": own == value or own.startswith(value + "-"), "^=": own.startswith(value), "$=": own.endswith(value), "*=": value in own}[sign]:
                return False
        if any(n.matches(node) for n in self.nots):
            return False
        return all(node.at(p) for p in self.places)


def _selector(text: str) -> list[tuple[str, Compound]] | None:
    """The compounds of a selector from the last one back, each with the sign between it and the next; None if it holds what is not known."""
    out, now, sign, at = [], Compound(), "", 0
    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or not m[0]:
            return None
        if m[1] is not None and not m[2]:
            out.append((sign, now))
            now, sign = Compound(), m[1].strip() or " "
        elif m[2]:
            now.tag = m[2].lower()
        elif m[3]:
            now.marks.add(m[3])
        elif m[4]:
            now.attrs.append((m[4].lower(), m[5] or "", next((v for v in m.group(6, 7, 8) if v is not None), "")))
        elif m[9] is not None:
            for inner in m[9].split(","):
                part = _selector(inner)
                if part is None or len(part) != 1:
                    return None
                now.nots.append(part[0][1])
        else:
            now.places.add(m[10].lower())
        at = m.end()
    out.append((sign, now))
    return out[::-1]


def _holds(parts: list[tuple[str, Compound]], node: Node) -> bool:
    """All compounds match, from the element back. Of ancestors and earlier siblings the nearest that matches is taken, and others before it are tried."""
    stack = [(0, node)]
    while stack:
        i, node = stack.pop()
        sign, compound = parts[i]
        if not compound.matches(node):
            if i and parts[i - 1][0] in (" ", "~"):  # look further back for this compound
                further = node.up if parts[i - 1][0] == " " else node.before()
                if further is not None:
                    stack.append((i, further))
            continue
        if i + 1 == len(parts):
            return True
        if i and parts[i - 1][0] in (" ", "~"):
            further = node.up if parts[i - 1][0] == " " else node.before()
            if further is not None and sign in (">", "+"):  # this match may not lead on where another does
                stack.append((i, further))
        then = node.up if sign in (" ", ">") else node.before()
        if then is not None:
            stack.append((i + 1, then))
    return False


class Styles:
    """The rules of a page's style sheets on ``display`` and ``visibility``, listed by what the last compound names."""

    def __init__(self) -> None:
        self.given: dict[tuple[str, str], tuple] = {}  # of equal selectors the weightiest rule
        self.by: dict[str, dict[str, list[tuple]]] = {}  # property -> "#id", ".class", tag or "*"
        self.count = 0

    def add(self, css: str) -> None:
        for prelude, body in _rules(css):
            found = _DECLARATION.findall(body)
            for selector in prelude.split(",") if found and ":not(" not in prelude else [prelude] if found else ():
                parts = _selector(selector)
                if parts is None:
                    continue
                flat = [c for _, c in parts] + [n for _, c in parts for n in c.nots]
                ids = sum(m[0] == "#" for c in flat for m in c.marks)
                classes = sum(len(c.marks) + len(c.attrs) + len(c.places) for c in flat) - ids
                for name, value, important in found:
                    self.count += 1
                    weight = (bool(important), 0, ids, classes, sum(c.tag != "*" for c in flat), self.count)
                    key = (selector.strip(), name.lower())
                    if key not in self.given or self.given[key][0] < weight:
                        self.given[key] = (weight, parts, value.lower())

    def close(self) -> None:
        """All rules are known: each is listed under its rarest mark, the weightiest first."""
        often: defaultdict[str, int] = defaultdict(int)
        for _, parts, _ in self.given.values():
            for m in parts[0][1].marks:
                often[m] += 1
        self.by = {"display": defaultdict(list), "visibility": defaultdict(list)}
        for (_, name), rule in sorted(self.given.items(), key=lambda x: x[1][0], reverse=True):
            last = rule[1][0][1]
            self.by[name][min(last.marks, key=lambda m: (m[0] != "#", often[m], m)) if last.marks else last.tag].append(rule)

    def of(self, node: Node) -> dict[str, str]:
        """What holds for an element by its own style and the rules."""
        attrs, found = node.attrs, {}
        own = [((bool(i), 1, 0, 0, 0, n), name.lower(), value.lower()) for n, (name, value, i) in enumerate(_DECLARATION.findall(attrs["style"]))] if "style" in attrs else []
        for name in ("display", "visibility"):
            best = max(((w, v) for w, n, v in own if n == name), default=None)
            if self.count:
                for key in (*node.marks(), node.tag, "*"):
                    for weight, parts, value in self.by[name].get(key, ()):
                        if best is not None and weight <= best[0]:
                            break
                        if _holds(parts, node):
                            best = (weight, value)
                            break
            if best is not None:
                found[name] = best[1]
        return found


def apply_styles(root: Node) -> None:
    """Sets ``shown`` of all elements, and takes the text out of those that are not visible."""
    styles, stack = Styles(), [root]
    while stack:
        node = stack.pop()
        if node.tag == "style" and node.space == "" and _for_screens(node.attrs.get("media", "")):
            styles.add("".join(c for c in node.children if isinstance(c, str)))
        inside = [c for c in node.children if isinstance(c, Node)]
        for n, c in enumerate(inside):
            c.up, c.number, c.siblings = node, n, inside
        stack.extend(reversed(inside))
    styles.close()
    walk = [(root, False)]
    while walk:
        node, hidden = walk.pop()
        held = styles.of(node) if styles.count or "style" in node.attrs else {}
        unseen = node.tag in UNSEEN or node.space == "none" or node.tag == "img" or node.tag == "input" and not node.label()
        closed = "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs
        node.shown = not unseen and (held["display"] != "none" if "display" in held else not closed)
        if not node.shown:
            continue
        if held.get("visibility") in ("hidden", "collapse", "visible"):
            hidden = held["visibility"] != "visible"
        if hidden:
            node.shown = node.tag != "hr"
            node.children = [c for c in node.children if isinstance(c, Node)]
            node.attrs = {k: v for k, v in node.attrs.items() if k not in ("label", "value")}
        walk.extend((c, hidden) for c in node.children if isinstance(c, Node))


def visible(node: Node) -> bool:
    return node.shown


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in text)


class _Lines:
    """Collects inline text into lines with collapsed white space."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # an empty line is due before the next text
        self.mark = ""  # due before the next line

    def text(self, value: str) -> None:
        self.now.append(value)

    def end_line(self) -> None:
        line = _WHITE.sub(" ", "".join(self.now)).strip(" ")
        self.now = []
        if line:
            self._add([line])

    def block(self, lines: list[str]) -> None:
        """Lines that are ready."""
        self.end_line()
        if lines:
            self._add(lines)

    def _add(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.extend(lines)
        if self.mark:
            self.lines[-len(lines)] = self.mark + lines[0]
            self.mark = ""

    def space(self) -> None:
        self.end_line()
        self.gap = True


def _rows(table: Node) -> tuple[list[Node | str], list[tuple[int, list[Node]]]]:
    """Captions, and rows of cells with the number of their section; contents outside of rows and cells count as captions."""
    captions, rows = [], []
    stack = [(c, 0) for c in reversed(table.children)]
    sections = 0
    while stack:
        child, section = stack.pop()
        if isinstance(child, str):
            if child.strip():
                captions.append(child)
        elif not visible(child):
            continue
        elif child.tag in ("tbody", "thead", "tfoot"):
            sections += 1
            stack.extend((c, sections) for c in reversed(child.children))
        elif child.tag == "tr":
            cells = []
            for c in child.children:
                if isinstance(c, str):
                    if c.strip():
                        captions.append(c)
                elif visible(c):
                    (cells if c.tag in ("td", "th") else captions).append(c)
            rows.append((section, cells))
        elif child.tag not in ("colgroup", "col"):
            captions.append(child)
    return captions, rows


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    number = int(value[:9])
    return most if not number and name == "rowspan" else min(max(number, 1), most)


class _Taken:
    """Columns that cells of rows above still take, as runs; what a cell takes is given back after its last row."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # a heap of last row, start, end

    def free(self, column: int) -> int:
        """The first free column from ``column`` on."""
        i = bisect_right(self.starts, column) - 1
        return max(column, self.ends[i]) if i >= 0 else column

    def take(self, start: int, end: int, last: int) -> None:
        """The free columns of a range, up to row ``last``."""
        while start < end:
            start = self.free(start)
            i = bisect_right(self.starts, start)
            stop = min(end, self.starts[i]) if i < len(self.starts) else end
            if start >= stop:
                return
            heappush(self.until, (last, start, stop))
            left, right = i and self.ends[i - 1] == start, i < len(self.starts) and self.starts[i] == stop
            if left and right:
                self.ends[i - 1] = self.ends[i]
                del self.starts[i], self.ends[i]
            elif left:
                self.ends[i - 1] = stop
            elif right:
                self.starts[i] = start
            else:
                self.starts.insert(i, start)
                self.ends.insert(i, stop)
            start = stop

    def give_back(self, row: int) -> None:
        """What was taken up to a row before ``row``."""
        while self.until and self.until[0][0] < row:
            _, start, end = heappop(self.until)
            i = bisect_right(self.starts, start) - 1
            before, after = (self.starts[i], start), (end, self.ends[i])
            parts = [p for p in (before, after) if p[0] < p[1]]
            self.starts[i : i + 1], self.ends[i : i + 1] = [p[0] for p in parts], [p[1] for p in parts]


def _places(rows: list[tuple[int, list[Node]]]) -> list[list[tuple[int, Node]]]:
    """The cells of each row with their columns, beside the cells that reach down from rows above."""
    out, taken, section = [], _Taken(), None
    for row, (own, cells) in enumerate(rows):
        if own != section:
            taken, section = _Taken(), own
        taken.give_back(row)
        line, column, new = [], 0, []
        for cell in cells:
            column = taken.free(column)
            line.append((column, cell))
            wide, high = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
            if high > 1:
                new.append((column, column + wide, row + high - 1))
            column += wide
        for part in new:
            taken.take(*part)
        out.append(line)
    return out


# The walk: each step yields the steps it needs done first, and ``_walk`` keeps them on a stack of its own,
# so that no depth of a page exhausts Python's. ``level`` counts quotes and list items around.
Step = Generator[Any, list[str] | None, list[str] | None]
_DEEPEST = 50  # indentation grows no further than so many quotes and list items; all else goes on
_WIDEST = 80  # cells are wrapped at spaces beyond this, and columns are aligned up to it


def _walk(step: Step) -> list[str] | None:
    stack, value = [step], None
    while stack:
        try:
            below = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(below)
            value = None
    return value


def _table(table: Node, level: int) -> Step:
    captions, rows = _rows(table)
    out: list[str] = []
    for c in captions:
        part = _Lines()
        if isinstance(c, str):
            part.text(c)
        else:
            yield _inline_or_block(c, part, level)
        part.end_line()
        out += part.lines
    grid = []
    for places in _places(rows):
        line = []
        for column, c in places:
            line.append((column, _wrapped((yield _children(c, level)))))
        grid.append(line)
    widths: dict[int, int] = {}  # of the columns in which a cell begins
    for line in grid:
        for column, cell in line:
            widths[column] = max(widths.get(column, 0), *(min(_WIDEST, w) for w in map(_width, cell)), 0)
    columns = sorted(widths)
    if len(columns) == 1:
        return out + [x for line in grid for _, cell in line for x in cell if x]
    room = sum(64 + 4 * len(x) for line in grid for _, cell in line for x in cell)  # for columns that are empty in a row
    for line in grid:
        for i in range(max((len(cell) for _, cell in line), default=0)):
            row, at, due = [], 0, 0  # spaces due before the next cell that has text here
            for column, cell in line:
                if i >= len(cell) or not cell[i]:
                    continue
                place = bisect_left(columns, column)
                for k in range(at, place):
                    due += widths[columns[k]] + 2
                    room -= widths[columns[k]] + 2
                    if room < 0:
                        break
                row.append(" " * due + cell[i])
                due, at = max(0, widths[column] - _width(cell[i])) + 2, place + 1
            if row:
                out.append("".join(row))
    return out


def _wrapped(lines: list[str]) -> list[str]:
    """Lines of a cell, those beyond ``_WIDEST`` cut at spaces."""
    out = []
    for line in lines:
        if len(line) <= _WIDEST:
            out.append(line)
            continue
        now: list[str] = []
        size = 0
        for word in line.split(" "):
            if now and size + len(word) > _WIDEST:
                out.append(" ".join(now).rstrip())
                now, size = [], 0
            now.append(word)
            size += len(word) + 1
        out.append(" ".join(now).rstrip())
    return out


def _each(nodes: list[Node | str], out: _Lines, level: int) -> Step:
    for child in nodes:
        if isinstance(child, str):
            out.text(child)
        elif visible(child):
            yield _inline_or_block(child, out, level)


def _children(node: Node, level: int) -> Step:
    lines = _Lines()
    yield _each(node.children, lines, level)
    lines.end_line()
    return lines.lines


def _shown(node: Node) -> list[Node | str]:
    """The children of a node, only the summary in closed details."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"]
    return node.children


def _flat(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif visible(x):
            out.append(" " if x.tag in BLOCK or x.tag in APART or x.tag == "br" else "")
            stack.extend(reversed(_shown(x)))
    return "".join(out)


def _preformatted(text: str) -> list[str]:
    return [x.rstrip() for x in text.strip("\n").split("\n")] if text.strip() else []


def _inline_or_block(node: Node, out: _Lines, level: int) -> Step:
    """Writes a visible element."""
    tag = node.tag
    if tag == "br":
        out.end_line()
        return
    if tag == "textarea":
        out.block(_preformatted("".join(x for x in node.children if isinstance(x, str))))
        return
    if tag not in BLOCK:
        apart = tag in APART or tag == "tspan" and not node.attrs.keys().isdisjoint(("x", "y", "dy"))
        if apart:
            out.text(" ")
        if tag == "input":
            out.text(f" {node.label()} ")
        if tag == "optgroup":
            out.text(node.attrs.get("label", "") + " ")
        if tag == "mfrac":
            for child in node.children:
                yield _each([child], out, level)
                out.text(" ")
        else:
            yield _each(node.children, out, level)
        if apart:
            out.text(" ")
        return
    out.end_line()
    if tag in SPACED and not (tag in LISTS and node.attrs.get("_nested")):
        out.space()
    if tag == "pre":
        text = "".join(x if isinstance(x, str) else "\n" if x.tag == "br" else _flat(x) for x in node.children)
        out.block(_preformatted(text))
    elif tag == "table":
        out.block((yield _table(node, level)))
    elif tag in LISTS:
        yield _list(node, out, level)
    elif tag == "hr":
        out.block(["---"])
    else:
        indent = "    " if tag == "dd" else "> " if tag == "blockquote" else ""
        if indent and level < _DEEPEST:
            out.block([indent + x if x else x for x in (yield _children(node, level + 1))])
        else:
            yield _each(_shown(node), out, level)
            out.end_line()
    if tag in SPACED and not (tag in LISTS and node.attrs.get("_nested")):
        out.space()


def _whole(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?\d{1,9}\s*", value) else default


def _list(node: Node, out: _Lines, level: int) -> Step:
    step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
    items = sum(isinstance(c, Node) and c.tag == "li" and visible(c) for c in node.children) if step < 0 else 1
    number = _whole(node.attrs.get("start"), items)
    for child in node.children:
        if not (isinstance(child, Node) and child.tag == "li"):
            yield _each([child], out, level)
            continue
        if not visible(child):
            continue
        for inner in child.children:
            if isinstance(inner, Node) and inner.tag in LISTS:
                inner.attrs["_nested"] = "1"
        number = _whole(child.attrs.get("value"), number) if node.tag == "ol" else number
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += step
        if level >= _DEEPEST:
            out.end_line()
            out.mark += mark
            yield _each(child.children, out, level)
            out.end_line()
            out.mark = ""
            continue
        lines = yield _children(child, level + 1)
        pad = " " * len(mark)
        if lines:
            out.block([(mark if i == 0 else pad if x else "") + x for i, x in enumerate(lines)])


def render(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    root = parse(html)
    apply_styles(root)
    if not visible(root):
        return ""
    lines = _walk(_children(root, 0))
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` of each page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = [render(x) for x in batch["html"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["page_id"], pa.array(text, pa.string())], ["page_id", "text"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].alias("html"))
    return map_batches(rows, run, "page_id long, text string")
