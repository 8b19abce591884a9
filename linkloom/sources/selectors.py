"""Match CSS selectors while reading a page once, start tag by start tag.

Supported: tag, .class, [a], [a=v], [a~=v], [a*=v], [a^=v], [a$=v], :not([...]),
descendant and child combinators, and commas.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# void elements, per the HTML standard
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = ("script", "style")

# fixed values of the HTML standard: classes of elements that decide which end tags may be left out
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_LISTS = frozenset(("ol", "ul"))
_SPECIAL = frozenset(
    """address applet article aside blockquote body button caption center colgroup dd details dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe li listing main marquee menu
    nav noscript object ol p plaintext pre script search section select style summary table tbody td template textarea
    tfoot th thead title tr ul xmp""".split()
)
_FIRM = _SPECIAL - {"address", "div", "p"}
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
_ENDS_P = frozenset(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1
    h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul
    xmp""".split()
)
_SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
_TABLE_ENDS = {
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("tr", "caption", "colgroup"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "caption", "colgroup"),
    "thead": ("tbody", "thead", "tfoot", "tr", "caption", "colgroup"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "caption", "colgroup"),
}
_TABLE_PARTS = frozenset("caption table tbody td tfoot th thead tr".split())
_STEP = re.compile(r"\s*(>)?\s*((?:[^\s>\[\](,]+|\[[^\]]*\]|\([^)]*\))+)\s*(,)?")
_PART = re.compile(r":not\(\s*(\[[^\]]*\]|\.[\w-]+)\s*\)|(\[[^\]]*\])|\.([\w-]+)|([\w-]+|\*)")
_ATTR = re.compile(r"""\[\s*([\w:-]+)\s*(?:([~*^$]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]]*?))\s*)?\]""")


def _test(text: str):
    if text.startswith("."):
        return ("class", "~=", text[1:])
    name, op, *values = _ATTR.fullmatch(text).groups()
    return (name.lower(), op, next((v for v in values if v is not None), ""))


def _compound(text: str):
    tag, want, avoid = None, [], []
    for negated, attribute, name, element in _PART.findall(text):
        if negated:
            avoid.append(_test(negated))
        elif attribute:
            want.append(_test(attribute))
        elif name:
            want.append(_test("." + name))
        elif element != "*":
            tag = element.lower()
    return tag, tuple(want), tuple(avoid)


def parse_selector(text: str):
    """Selector text → alternatives, each a list of (is_child, compound), left to right."""
    alternatives, steps = [], []
    for child, compound, comma in _STEP.findall(text):
        steps.append((bool(child), _compound(compound)))
        if comma:
            alternatives.append(tuple(steps))
            steps = []
    return tuple(alternatives + [tuple(steps)])


def _holds(test, attrs) -> bool:
    name, op, want = test
    have = attrs.get(name)
    if have is None:
        return False
    if op is None:
        return True
    if op == "=":
        return have == want
    if op == "~=":
        return want in have.split()
    if op == "*=":
        return want != "" and want in have
    if op == "^=":
        return want != "" and have.startswith(want)
    return want != "" and have.endswith(want)


def _fits(compound, tag, attrs) -> bool:
    name, want, avoid = compound
    return (
        (name is None or name == tag)
        and all(_holds(t, attrs) for t in want)
        and not any(_holds(t, attrs) for t in avoid)
    )


class RuleIndex:
    """Selector prefixes as numbered steps, filed under the tag or attribute each needs.

    An element completes a step when it fits the step's compound and its parent, or some ancestor, completed the step
    before. Rules with a common start share its steps.
    """

    def __init__(self, rules):
        self._numbers: dict[tuple, int] = {}
        self.steps: list[tuple] = []  # (mask of the step before, is_child, compound)
        self.ends: list[list] = []  # per step: rules (number, attribute, terms) that it completes
        self._by_tag: dict[str, list[int]] = {}
        self._by_attribute: dict[str, list[int]] = {}
        self._always: list[int] = []
        for number, (selector, attribute, terms) in enumerate(rules):
            for steps in selector:
                at = None
                for child, compound in steps:
                    at = self._step(at, child, compound)
                self.ends[at].append((number, attribute, terms))

    def _step(self, before, child, compound) -> int:
        key = (before, child, compound)
        if key not in self._numbers:
            number = self._numbers[key] = len(self.steps)
            self.steps.append((0 if before is None else 1 << before, child, compound))
            self.ends.append([])
            tag, want, _ = compound
            if tag is not None:
                self._by_tag.setdefault(tag, []).append(number)
            elif want:
                self._by_attribute.setdefault(want[0][0], []).append(number)
            else:
                self._always.append(number)
        return self._numbers[key]

    def completed(self, tag, attrs, parent: int, above: int) -> tuple[int, list]:
        """Mask of the steps an element completes, and the rules, each once, in their order.

        `parent` holds the steps its parent completed, `above` those of all ancestors.
        """
        mask, rules = 0, {}
        for group in (self._by_tag.get(tag, ()), self._always, *(self._by_attribute.get(a, ()) for a in attrs)):
            for number in group:
                before, child, compound = self.steps[number]
                if (not before or before & (parent if child else above)) and _fits(compound, tag, attrs):
                    mask |= 1 << number
                    for rule in self.ends[number]:
                        rules[rule[0]] = rule
        return mask, [rules[n] for n in sorted(rules)]


class OpenElements:
    """The elements that are open at a place of the page, with their last places by name."""

    def __init__(self):
        self.names: list[str | None] = []  # None: ended while a block inside it goes on
        self.masks: list[tuple[int, int]] = []  # steps completed by the element; and by it or an ancestor
        self.waiting: list[list] = []  # hits that wait for the element's text
        self._places: dict[str, list[int]] = {}
        self._walls: dict[frozenset, list[int]] = {group: [] for group in (_SPECIAL, _FIRM, _SCOPE, _LISTS)}

    def last(self, *names: str) -> int:
        return max((self._places[n][-1] for n in names if self._places.get(n)), default=-1)

    def wall(self, *groups: frozenset) -> int:
        return max((self._walls[g][-1] for g in groups if self._walls[g]), default=-1)

    def push(self, name: str, masks: tuple[int, int], waiting: list) -> None:
        at = len(self.names)
        self.names.append(name)
        self.masks.append(masks)
        self.waiting.append(waiting)
        self._places.setdefault(name, []).append(at)
        for group, places in self._walls.items():
            if name in group:
                places.append(at)

    def end(self, at: int) -> list:
        """Ends the last element of its name, but not those inside it; its waiting hits."""
        name, self.names[at] = self.names[at], None
        if name is not None:
            self._places[name].pop()
            for group, places in self._walls.items():
                if name in group:
                    places.pop()
        found, self.waiting[at] = self.waiting[at], []
        return found

    def pop(self) -> list:
        found = self.end(len(self.names) - 1)
        self.names.pop()
        self.masks.pop()
        self.waiting.pop()
        return found


class PageReader(HTMLParser):
    """Collects [rule, element, value, terms] for every rule, in document order.

    End tags that a page may leave out are supplied as the HTML standard has it: for list items, terms, paragraphs,
    options, table parts, headings, nested links and buttons. An end tag does not reach out of its table cell.
    """

    def __init__(self, rules: RuleIndex):
        super().__init__(convert_charrefs=True)
        self._rules = rules
        self._open = OpenElements()
        self._text: list[str] = []
        self._count = 0
        self.hits: list[list] = []

    def handle_starttag(self, tag, attrs):
        found = {}
        for name, value in attrs:
            found.setdefault(name, value or "")
        self._end_implied(tag)
        self._count += 1
        parent, above = self._open.masks[-1] if self._open.masks else (0, 0)
        mask, rules = self._rules.completed(tag, found, parent, above)
        waiting = []
        for number, attribute, terms in rules:
            hit = [number, self._count, found.get(attribute.lower()), found.get(terms) if terms else None]
            if attribute == "textContent":
                hit[2] = ""
                waiting.append((hit, len(self._text)))
            if hit[2] is not None:
                self.hits.append(hit)
        if tag not in _VOID:
            self._open.push(tag, (mask, above | mask), waiting)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self._open.last("svg", "math") >= 0:  # elsewhere the slash means nothing
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        e = self._open
        if tag in _HEADINGS:
            at, wall = e.last(*_HEADINGS), e.wall(_SCOPE)
        elif tag in _TABLE_PARTS:
            at, wall = e.last(tag), e.last("table") - (tag == "table")
        elif tag == "li":
            at, wall = e.last(tag), e.wall(_SCOPE, _LISTS)
        else:
            at, wall = e.last(tag), e.wall(_SCOPE) - (tag in _SCOPE)
        if at < 0 or at <= wall:
            return
        if tag in _SPECIAL or at > e.wall(_SPECIAL):
            self._end_from(at)
        elif tag in _FORMATTING:
            self._texts(e.end(at))

    def handle_data(self, data):
        if not self._open.names or self._open.names[-1] not in _HIDDEN:
            self._text.append(data)

    def _end_implied(self, tag: str) -> None:
        e = self._open
        if tag in _ENDS_P:
            at = e.last("p")
            if at > max(e.wall(_SCOPE), e.last("button")):
                self._end_from(at)
        if tag in _SIBLINGS:
            at = e.last(*_SIBLINGS[tag])
            if at >= 0 and at >= e.wall(_FIRM):
                self._end_from(at)
        elif tag in _HEADINGS:
            if e.names and e.names[-1] in _HEADINGS:
                self._end_from(len(e.names) - 1)
        elif tag in _TABLE_ENDS:
            table = e.last("table")
            places = [at for at in map(e.last, _TABLE_ENDS[tag]) if at > table]
            if places:
                self._end_from(min(places))
            if tag == "tr" and e.names and e.names[-1] == "table":
                self.handle_starttag("tbody", [])
        elif tag == "a":
            at = e.last("a")
            if at >= 0 and at > e.wall(_SPECIAL):
                self._end_from(at)
        elif tag in ("option", "optgroup"):
            at = e.last(*(("option",) if tag == "option" else ("option", "optgroup")))
            if at > e.last("select", "datalist") and at > e.wall(_SCOPE):
                self._end_from(e.last("optgroup") if tag == "optgroup" and e.last("optgroup") > e.last("select") else at)
        elif tag == "button":
            at = e.last("button")
            if at > e.wall(_SCOPE):
                self._end_from(at)
        elif tag == "body" and e.last("head") >= 0:
            self._end_from(e.last("head"))

    def _end_from(self, at: int) -> None:
        while len(self._open.names) > at:
            self._texts(self._open.pop())

    def _texts(self, waiting: list) -> None:
        for hit, start in waiting:
            hit[2] = "".join(self._text[start:])

    def read(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        self._end_from(0)
        return self.hits
