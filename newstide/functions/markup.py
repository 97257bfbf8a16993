"""Title and article text of stored web pages.

Elements nest and end tags may be left out, so a page is read by a parser and not by patterns: one
Arrow UDF over the markup, page by page. Tags are cut out from left to right; a stack of open
elements decides what each of them ends, by the rules HTML gives for implied end tags and scopes.
For every element name and every kind of scope the places on the stack are kept, so an end tag finds
its element at once: the work grows with the length of the page, whatever its markup is like.

A page that cannot be read loses its text and title only; ``error`` says why.
"""

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import functions as F, types as T

# Elements that hold no text of the page, those without an end tag, those that stand
# for a line of their own, and class names of advertisements.
NOISE = frozenset("script style nav noscript template svg math".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param "
                 "source track wbr".split())
LINES = frozenset("p br h1 h2 h3 h4 h5 h6 div li ul ol tr table blockquote".split())
AD_CLASSES = frozenset("ad ads advert advertisement sponsored".split())
# Where the text of a page is looked for, best first.
BODIES = ("article", "main", "body")

# Fixed values of the HTML standard: elements whose content is no markup; those that end an open
# paragraph; headings; those that leave the head of a page in place; those that end foreign markup.
RAW = frozenset("script style xmp iframe noembed noframes textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary "
    "table ul xmp dd dt".split())
HEAD = frozenset("html head title base basefont bgsound link meta noframes noscript script style "
                 "template".split())
FOREIGN = frozenset(("svg", "math"))
LEAVES_FOREIGN = CLOSES_P - {"form", "article", "aside", "section"} | frozenset(
    "b big body br code em embed head i img meta nobr ruby s small span strong strike sub sup tt u "
    "var".split())

# Elements that bound a search on the stack. An end tag looks for its element up to
# "scope" (a paragraph: "button"), a table part up to "table", a list item up to "list"; an end tag
# of an inline element gives up at any "special" one.
_SCOPE = "applet caption html table td th marquee object template foreignobject".split()
_SPECIAL = CLOSES_P | frozenset(_SCOPE) | frozenset(
    "area base body br button col colgroup embed frame frameset head iframe img input link meta "
    "noembed noframes noscript object param script select source style tbody textarea tfoot thead "
    "title tr track wbr svg math".split())
BOUNDS = {"scope": frozenset(_SCOPE), "button": frozenset([*_SCOPE, "button"]),
          "table": frozenset(("html", "table", "template")),
          "list": _SPECIAL - {"address", "div", "p", "li", "dd", "dt"},
          "select": frozenset(("select", "datalist", "html", "template")), "special": _SPECIAL}
# What a start tag ends first: (elements, scope they have to be in).
ENDS = {"li": (("li",), "list"), "dd": (("dd", "dt"), "list"), "dt": (("dd", "dt"), "list"),
        "option": (("option",), "select"), "optgroup": (("optgroup", "option"), "select"),
        "td": (("td", "th", "caption"), "table"), "th": (("td", "th", "caption"), "table"),
        "tr": (("tr", "caption", "colgroup"), "table"),
        **{part: (("tbody", "thead", "tfoot", "caption", "colgroup", "tr"), "table")
           for part in ("tbody", "thead", "tfoot", "caption", "colgroup")}}
# Scope of an end tag; those not named here are inline.
END_SCOPE = {**dict.fromkeys(_SPECIAL, "scope"), "p": "button", "li": "list", "dd": "list",
             "dt": "list", **dict.fromkeys("table tr td th tbody thead tfoot caption".split(), "table")}

_SCOPES_OF = {tag: tuple(scope for scope, names in BOUNDS.items() if tag in names)
              for tag in frozenset().union(*BOUNDS.values())}

PARTS = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("error", T.StringType())])

_BLANKS = re.compile(r"[ \t\r\f]+")
_BREAKS = re.compile(r" *\n[ \n]*")
_NAME = re.compile(r"[A-Za-z][^\s/>\0]*+")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"[^>][^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
# Where a title without an end tag ends at the latest.
_NO_TITLE = re.compile(r"</head[\s/>]|<body[\s/>]", re.I)
_ELEMENT = re.compile(r"</?(?:" + "|".join(sorted(_SPECIAL | HEAD | {"a", "b", "i", "span"}))
                      + r")[\s/>]", re.I)


def tidy(text: str) -> str | None:
    """Runs of blanks and line breaks made single, ends trimmed; None when nothing is left."""
    return _BREAKS.sub("\n", _BLANKS.sub(" ", text)).strip(" \n") or None


class _Search:
    """Next place of a pattern in a page; what was found is kept, so the page is read once for it."""

    def __init__(self, page: str):
        self.page = page
        self.next: dict[str, int] = {}

    def __call__(self, pattern: re.Pattern, at: int) -> int:
        """Place of the first match from ``at`` on, the page's length without any."""
        known = self.next.get(pattern.pattern, -1)
        if known < at:
            match = pattern.search(self.page, at)
            known = self.next[pattern.pattern] = match.start() if match else len(self.page)
        return known


class _Stack:
    """Open elements, and where on the stack each name and each bound of a scope is."""

    def __init__(self):
        self.open: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.bounds: dict[str, list[int]] = {scope: [] for scope in BOUNDS}
        self.skipped = 0

    def push(self, tag: str, skip: bool) -> None:
        at = len(self.open)
        self.open.append((tag, skip))
        self.places[tag].append(at)
        for scope in _SCOPES_OF.get(tag, ()):
            self.bounds[scope].append(at)
        self.skipped += skip

    def pop(self) -> tuple[str, bool]:
        tag, skip = self.open.pop()
        self.places[tag].pop()
        for scope in _SCOPES_OF.get(tag, ()):
            self.bounds[scope].pop()
        self.skipped -= skip
        return tag, skip

    def place(self, tag: str, scope: str) -> int | None:
        """Where the innermost open ``tag`` is, None if there is none or a bound lies above it."""
        places, bounds = self.places.get(tag), self.bounds[scope]
        if not places or bounds and bounds[-1] > places[-1]:
            return None
        return places[-1]


class _Page:
    """Builds the stack from the tags; collects the title and, per kind of body, the text of its
    first outermost element."""

    def __init__(self, html: str):
        self.html, self.find, self.stack = html, _Search(html), _Stack()
        self.title: str | None = None
        self.marked = False
        self.found: dict[str, list[str]] = {"body": []}
        self.current: set[str] = {"body"}

    def put(self, text: str) -> None:
        if not self.stack.skipped:
            for body in self.current:
                self.found[body].append(text)

    def close_to(self, place: int) -> None:
        """End all elements from ``place`` of the stack on."""
        while len(self.stack.open) > place:
            tag, skip = self.stack.pop()
            if tag in LINES and not skip:
                self.put("\n")
            if tag in self.current and not self.stack.places[tag]:
                self.current.discard(tag)

    def close(self, tag: str, scope: str) -> bool:
        place = self.stack.place(tag, scope)
        if place is not None:
            self.close_to(place)
        return place is not None

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        stack = self.stack
        inside = next((f for f in FOREIGN if stack.place(f, "scope") is not None), None)
        if inside and tag in LEAVES_FOREIGN:
            self.close(inside, "scope")
            inside = None
        if tag in ("html", "head", "body"):
            return
        if not inside:
            ended, scope = ENDS.get(tag, ((), "scope"))
            for other in ended:
                self.close(other, scope)
            if tag in CLOSES_P:
                self.close("p", "button")
            if tag in HEADINGS and stack.open and stack.open[-1][0] in HEADINGS:
                self.close_to(len(stack.open) - 1)
        empty = tag in VOID or closed and (inside or tag in FOREIGN)
        skip = not empty and (tag in NOISE or not AD_CLASSES.isdisjoint(
            attributes.get("class", "").lower().split()))
        if skip or tag in LINES:
            self.put(" " if skip else "\n")
        if not empty:
            stack.push(tag, skip)
            if tag in BODIES and tag not in self.found and not stack.skipped:
                self.found[tag] = []
                self.current.add(tag)

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag in HEADINGS:
            places = [at for h in HEADINGS if (at := self.stack.place(h, "scope")) is not None]
            if places:
                self.close_to(max(places))
        elif not self.close(tag, END_SCOPE.get(tag, "special")) and tag in ("p", "br"):
            self.put("\n")

    def attributes(self, at: int) -> tuple[dict[str, str], int | None, bool]:
        """Attributes of a tag from ``at`` behind its name, where the tag ends (None: nowhere), and
        whether it closes itself."""
        html, found = self.html, {}
        while True:
            gap = _GAP.match(html, at)
            at = gap.end()
            if at >= len(html):
                return found, None, False
            if html[at] == ">":
                return found, at + 1, gap[0].endswith("/")
            name = _ATTRIBUTE.match(html, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(html, at):
                at = equals.end()
                if html[at:at + 1] in ('"', "'") and at < len(html):
                    stop = html.find(html[at], at + 1)
                    if stop < 0:
                        return found, None, False
                    value, at = html[at + 1:stop], stop + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            found.setdefault(name[0].lower(), value)

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content of an element ends that holds no markup. A title without an end tag
        before the body ends at the first element of a body."""
        stop = self.find(re.compile(rf"</{tag}(?=[\s/>])", re.I), at)
        if tag == "title":
            late = self.find(_NO_TITLE, at)
            if stop >= min(late, len(self.html) - 1):
                stop = self.find(_ELEMENT, at)
        return stop

    def read(self) -> None:
        html, at = self.html, 0
        while at < len(html):
            tag_at = html.find("<", at)
            if tag_at < 0:
                tag_at = len(html)
            if tag_at > at:
                self.put(unescape(html[at:tag_at]))
            if tag_at + 1 >= len(html):
                self.put(html[tag_at:])
                return
            following = html[tag_at + 1]
            if html.startswith("<!--", tag_at):
                end = _COMMENT_END.search(html, tag_at + 2)
                stop = end.end() if end else None
            elif following in "!?" or following == "/" and not _NAME.match(html, tag_at + 2):
                stop = html.find(">", tag_at + 2) + 1 or None
            elif name := _NAME.match(html, tag_at + 1 + (following == "/")):
                tag = name[0].lower()
                self.marked = True
                attributes, stop, closed = self.attributes(name.end())
                if stop is not None and following == "/":
                    self.end(tag)
                elif stop is not None:
                    stop = self.element(tag, attributes, closed, stop)
            else:
                self.put("<")
                stop = tag_at + 1
            if stop is None:  # a tag or comment that never ends takes the rest of the page
                return
            at = stop

    def element(self, tag: str, attributes: dict[str, str], closed: bool, at: int) -> int:
        """Open an element; where to read on."""
        foreign = any(self.stack.places.get(f) for f in FOREIGN)
        if foreign or tag not in RAW and tag != "title":
            self.start("img" if tag == "image" else tag, attributes, closed)
            return at
        stop = self.raw_end(tag, at)
        if tag == "title":
            if self.title is None and not self.stack.skipped:
                self.title = unescape(self.html[at:stop])
            return stop
        self.start(tag, attributes, False)
        if tag in ("textarea", "xmp"):
            content = self.html[at:stop]
            self.put(unescape(content) if tag == "textarea" else content)
        return stop


def read_page(html: str | None) -> tuple[str | None, str | None]:
    """(title, text) of a page: the text of its first outermost article, else of its main part or
    body, without scripts, navigation and advertisements. Start and end tags that HTML lets a page
    leave out are implied, those of the body too; an element that never ends goes as far as the one
    it is in. A page of bytes that are no text is refused with a ``ValueError``."""
    if html is None:
        return None, None
    if "\0" in html:
        raise ValueError("no text: a NUL character")
    page = _Page(html)
    page.read()
    if not page.marked:
        return None, None
    texts = (tidy("".join(page.found[body])) for body in BODIES if body in page.found)
    return tidy(page.title or ""), next((text for text in texts if text), None)


def _read(html: str | None) -> dict[str, str | None]:
    try:
        title, text = read_page(html)
        return {"title": title, "text": text, "error": None}
    except Exception as failure:  # whatever a page does, it is not to fail the others
        return {"title": None, "text": None, "error": f"{type(failure).__name__}: {failure}"[:200]}


@F.arrow_udf(PARTS)
def page_parts(html: pa.Array) -> pa.Array:
    return pa.array([_read(one.as_py()) for one in html],
                    pa.struct([(f, pa.string()) for f in PARTS.names]))
