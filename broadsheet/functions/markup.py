"""Parse one page of HTML into plain arrays, inside Arrow-batched UDFs.

Only the tag structure is read here.  Filters, counts and reasons are column
expressions over the arrays that leave these functions.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, StringType

from .patterns import class_hit, hit, parse_once

# Send these functions to the executors with the job, so that they need not
# have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How tags close each other in lenient HTML.  An opening tag
# closes the open tags listed for it; an end tag does not reach past an open
# tag of higher rank.
STYLE = {"tt", "i", "b", "u", "s", "strike", "big", "small"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OPENING_CLOSES = {
    "p": {"p"} | HEADINGS | STYLE,
    "div": {"p"},
    "ul": {"p"},
    "ol": {"p"},
    "dl": {"p", "dt"},
    "dt": {"p", "dd"},
    "dd": {"p", "dt"},
    "li": {"p", "li"} | HEADINGS,
    "hr": {"p"},
    "pre": {"p"},
    "address": {"p"},
    "blockquote": {"p"},
    "center": {"p", "font", "b", "i"},
    "form": {"p", "form"} | HEADINGS,
    "table": {"p", "a"} | HEADINGS,
    "tr": {"p", "td", "th", "tr", "caption", "col", "colgroup"},
    "td": {"p", "td", "th", "span", "font", "a", "b", "i", "u"},
    "th": {"p", "td", "th", "span", "font", "a", "b", "i", "u"},
    "option": {"option"},
    "a": {"a"},
} | {name: {"p"} | HEADINGS for name in HEADINGS}
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}
EMPTY_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param"}
RAW_TEXT = {"script", "style", "template"}
LIST_ATTRIBUTES = {"class", "accesskey", "dropzone", "rel", "rev", "headers"}


#: Pages that are Python strings at one time; a batch of them may be much larger.
SLICE_ROWS = 64


def _of_rows(function: Callable, type_: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``function`` of each row, a slice of rows after the other."""
    slices = (
        zip(*(column.slice(at, SLICE_ROWS).to_pylist() for column in columns))
        for at in range(0, len(columns[0]), SLICE_ROWS)
    )
    return pa.concat_arrays([pa.array([], type_), *(pa.array([function(*row) for row in rows], type_) for rows in slices)])


_ATTRIBUTES = r"""(?:[\s/]*+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+[\s/]*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)                                       # comment
    | <(?P<raw>script|style)\b{_ATTRIBUTES}>.*?</(?P=raw)\s*>  # text that is no markup
    | <(?P<open>[a-z][^\s/>]*+)(?P<attributes>{_ATTRIBUTES})>
    | </(?P<close>[a-z][^\s/>]*+)[^>]*+>
    | <[!?][^>]*+>                                             # doctype and the like""",
    re.VERBOSE | re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")


def _read_attributes(source: str) -> dict[str, str]:
    """Attribute values by lower-case name; the first of a repeated name wins."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in {"'", '"'}:
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value))
    return found


class _Outline:
    """Tags and texts of one page in document order; each tag knows its end."""

    def __init__(self, html: str) -> None:
        self.names: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.texts: list[str] = []
        self.text_spans: list[list[int]] = []
        self._stack: list[int] = []
        at = 0
        for token in _TOKEN.finditer(html):
            self._add_text(html[at : token.start()])
            at = token.end()
            if token["open"]:
                self._open(token["open"].lower(), token["attributes"])
            elif token["close"]:
                self._close(token["close"].lower())
        self._add_text(html[at:])
        while self._stack:
            self._close_top()

    def _add_text(self, text: str) -> None:
        if text and not (self._stack and self.names[self._stack[-1]] in RAW_TEXT):
            self.texts.append(unescape(text))

    def _open(self, name: str, attributes: str) -> None:
        closes = OPENING_CLOSES.get(name, ())
        while self._stack and self.names[self._stack[-1]] in closes:
            self._close_top()
        self.parents.append(self._stack[-1] if self._stack else -1)
        self.names.append(name)
        self.attributes.append(_read_attributes(attributes) if attributes else {})
        self.ends.append(len(self.names))
        self.text_spans.append([len(self.texts), len(self.texts)])
        if name not in EMPTY_TAGS and not attributes.endswith("/"):
            self._stack.append(len(self.names) - 1)

    def _close(self, name: str) -> None:
        """Close the nearest open tag of that name; a stray end tag is ignored."""
        rank = END_RANK.get(name, 100)
        for depth in range(len(self._stack) - 1, -1, -1):
            open_name = self.names[self._stack[depth]]
            if open_name == name:
                while len(self._stack) > depth:
                    self._close_top()
                return
            if END_RANK.get(open_name, 100) > rank:
                return

    def _close_top(self) -> None:
        tag = self._stack.pop()
        self.ends[tag] = len(self.names)
        self.text_spans[tag][1] = len(self.texts)

    def text(self, tag: int) -> str:
        start, end = self.text_spans[tag]
        return "".join(self.texts[start:end])


def _classes(attributes: dict[str, str]) -> list[str]:
    return attributes.get("class", "").split()


def _values(attributes: dict[str, str]) -> list[str]:
    """Attribute values: words of the list-valued ones, then the others whole."""
    words = [w for name, value in attributes.items() if name in LIST_ATTRIBUTES for w in value.split()]
    return words + _strings(attributes)


def _strings(attributes: dict[str, str]) -> list[str]:
    return [value for name, value in attributes.items() if name not in LIST_ATTRIBUTES]


def _class_hit(pattern: re.Pattern, attributes: dict[str, str]) -> bool:
    classes = _classes(attributes)
    return any(pattern.search(c) for c in classes) or (
        bool(classes) and pattern.search(" ".join(classes)) is not None
    )



TAG_TYPE = pa.list_(
    pa.struct(
        [
            ("name", pa.string()),
            ("classes", pa.list_(pa.string())),
            ("href", pa.string()),
            ("label", pa.string()),
            ("strings", pa.list_(pa.string())),
            ("values", pa.list_(pa.string())),
            ("hit", pa.bool_()),
        ]
    )
)


def _tags_of(html: str | None, rule: str | None) -> list[dict]:
    page = _Outline(html or "")
    return [
        {
            "name": name,
            "classes": _classes(attributes),
            "href": attributes.get("href"),
            "label": attributes.get("aria-label"),
            "strings": _strings(attributes),
            "values": _values(attributes),
            "hit": class_hit(rule, _classes(attributes)),
        }
        for name, attributes in zip(page.names, page.attributes)
        if "href" in attributes or "class" in attributes or "aria-label" in attributes
    ]


@parse_once
@arrow_udf(from_arrow_type(TAG_TYPE))
def page_tags(html: pa.Array, rule: pa.Array) -> pa.Array:
    """Tags with an href, a class or an aria-label, in document order; ``hit`` by the page's class rule."""
    return _of_rows(_tags_of, TAG_TYPE, html, rule)


def _hrefs_of(html: str | None) -> list[str]:
    sources = (token["attributes"] for token in _TOKEN.finditer(html or "") if token["attributes"])
    read = (_read_attributes(source) for source in sources if "href" in source.lower())
    return [attributes["href"] for attributes in read if "href" in attributes]


@parse_once
@arrow_udf(ArrayType(StringType()))
def page_hrefs(html: pa.Array) -> pa.Array:
    """The href of every tag that has one, in document order."""
    return _of_rows(_hrefs_of, pa.list_(pa.string()), html)


def _wanted_hrefs_of(html: str | None, wanted: str | None, unwanted: list[str] | None) -> list[str]:
    return [h for h in _hrefs_of(html) if hit(wanted, h) and not any(hit(x, h) for x in unwanted or ())]


@parse_once
@arrow_udf(ArrayType(StringType()))
def wanted_hrefs(html: pa.Array, wanted: pa.Array, unwanted: pa.Array) -> pa.Array:
    """The hrefs of each page that its pattern is found in, and none of its exclusions."""
    return _of_rows(_wanted_hrefs_of, pa.list_(pa.string()), html, wanted, unwanted)


PARAGRAPH_TYPE = pa.list_(
    pa.struct(
        [
            ("parent", pa.string()),
            ("has_exclude", pa.bool_()),
            ("values", pa.list_(pa.string())),
            ("text", pa.string()),
        ]
    )
)
CONTAINER_TYPE = pa.struct(
    [("has_text", pa.bool_()), ("paragraphs", PARAGRAPH_TYPE), ("marked", PARAGRAPH_TYPE)]
)
EXCLUDE = re.compile("exclude")
PARAGRAPH = re.compile("paragraph")


def _container(page: _Outline, rule: str | None) -> int | None:
    """The first div by class, else article by class, else div by id.

    Without a rule the first article is meant.
    """
    tags = list(zip(page.names, page.attributes))
    if rule is None:
        return next((i for i, (name, _) in enumerate(tags) if name == "article"), None)
    pattern = re.compile(rule)
    for wanted in ("div", "article"):
        for i, (name, attributes) in enumerate(tags):
            if name == wanted and _class_hit(pattern, attributes):
                return i
    return next(
        (i for i, (name, at) in enumerate(tags) if name == "div" and "id" in at and pattern.search(at["id"])),
        None,
    )


def _paragraph(page: _Outline, i: int) -> dict:
    inside = range(i + 1, page.ends[i])
    return {
        "parent": page.names[page.parents[i]] if page.parents[i] >= 0 else None,
        "has_exclude": any(_class_hit(EXCLUDE, page.attributes[j]) for j in inside),
        "values": _values(page.attributes[i]),
        "text": page.text(i),
    }


def _content_of(html: str | None, rule: str | None) -> dict | None:
    page = _Outline(html or "")
    root = _container(page, rule)
    if root is None:
        return None
    inside = range(root + 1, page.ends[root])
    return {
        "has_text": page.text(root) != "",
        "paragraphs": [_paragraph(page, i) for i in inside if page.names[i] == "p"],
        "marked": [_paragraph(page, i) for i in inside if _class_hit(PARAGRAPH, page.attributes[i])],
    }


@parse_once
@arrow_udf(from_arrow_type(CONTAINER_TYPE))
def article_container(html: pa.Array, rule: pa.Array) -> pa.Array:
    """The article container of each page; NULL where the rule finds none.

    ``paragraphs`` are its ``<p>`` tags, ``marked`` its tags with a class like
    "paragraph", both in document order.
    """
    return _of_rows(_content_of, CONTAINER_TYPE, html, rule)
