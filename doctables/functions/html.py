"""Anchors of an HTML page.

Ordinary markup is tokenised in the JVM by one regular expression that consumes comments, raw-text
elements and every other tag, so an anchor inside a script, a comment or an attribute is not seen
as one. The expression only accepts strictly well-formed markup. Whatever it cannot consume shows
up as a one-character marker, and a page with a marker goes to the standard library's parser
instead. Where only an anchor holds character references other than ``&amp;``, that parser gets the
anchors and not the page. All ways give the same list.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.functions.urls import let

ANCHORS = T.ArrayType(
    T.StructType([T.StructField("href", T.StringType()), T.StructField("cls", T.StringType())])
)

_NAME = r"""[!-~&&[^"'<>/=]]+"""
_VALUE = r"""(?:"[^"]*"|'[^']*'|[!-~&&[^"'=<>`]][!-~&&[^"'<>`]]*)"""
_ATTRS = rf"(?:[ \t\n\r\f]+{_NAME}(?:[ \t\n\r\f]*=[ \t\n\r\f]*{_VALUE})?+)*+[ \t\n\r\f]*+"

_SKIPPED = "|".join(
    [
        r"!--(?!-?>)(?:[^-]++|-(?!-))*+-->",
        # Stops at the next opening of its kind, so unclosed elements are not scanned over and over.
        rf"(script|style){_ATTRS}>(?:[^<]++|<(?!/?\s*\1))*+</\1\s*>",
        r"!doctype[^<>]*>",
        r"/[a-z][a-z0-9:._-]*[ \t\n\r\f]*>",
        rf"(?!(?:a|script|style)[ \t\n\r\f/>])[a-z][a-z0-9:-]*{_ATTRS}/?>",
    ]
)
_TOKENS = rf"(?is)<(?:(?:{_SKIPPED})|(a(?=[ \t\n\r\f/>]){_ATTRS}/?>|[a-z!/?]))"
_ATTR = rf"(?is)({_NAME})(?:[ \t\n\r\f]*=[ \t\n\r\f]*({_VALUE}))?+"


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            given = {name: value or "" for name, value in attrs}
            if "href" in given:
                self.found.append({"href": given["href"], "cls": given.get("class")})


def parse_anchors(html: str) -> list[dict]:
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    return parser.found


@F.pandas_udf(ANCHORS)
def _parsed(pages: pd.Series) -> pd.Series:
    return pages.map(parse_anchors, na_action="ignore").astype(object).where(pages.notna(), None)


# Marked so that the optimizer never copies the call into a filter and parses twice.
_parsed = _parsed.asNondeterministic()


def anchor_tokens(html: Column) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(_TOKENS), F.lit(2)), lambda t: t != "")


def is_odd(tokens: Column) -> Column:
    """True where the page is not strictly well-formed."""
    return F.exists(tokens, lambda t: F.length(t) == 1)


def for_parser(html: Column, tokens: Column) -> Column:
    """What the standard parser has to see: the page, only its anchors, or (mostly) nothing."""
    references = F.exists(tokens, lambda t: F.replace(t, F.lit("&amp;"), F.lit("")).contains("&"))
    anchors = F.concat(F.lit("<"), F.array_join(tokens, "<"))
    return F.when(is_odd(tokens), html).when(references, anchors)


def _attribute(names: Column, values: Column, name: str) -> Column:
    """Last value given for an attribute, '' without a value, null when absent."""

    def bare(value: Column) -> Column:
        quoted = value.startswith('"') | value.startswith("'")
        inner = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.replace(inner, F.lit("&amp;"), F.lit("&"))

    back = F.array_position(F.reverse(names), name)
    return let(back, lambda n: F.when(n > 0, let(F.get(values, (F.size(names) - n).cast("int")), bare)))


def strict_anchors(tokens: Column) -> Column:
    """Anchors with an href from the tokens of a well-formed page."""

    def one(token: Column) -> Column:
        inner = F.substring(token, F.lit(2), F.length(token))
        names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTR), F.lit(1)), F.lower)
        values = F.regexp_extract_all(inner, F.lit(_ATTR), F.lit(2))
        return let(
            F.struct(names.alias("names"), values.alias("values")),
            lambda a: F.struct(
                _attribute(a["names"], a["values"], "href").alias("href"),
                _attribute(a["names"], a["values"], "class").alias("cls"),
            ),
        )

    return F.filter(F.transform(tokens, one), lambda a: a["href"].isNotNull())


def parsed_anchors(markup: Column) -> Column:
    return _parsed(markup)


def class_matches(cls: Column, wanted: str) -> Column:
    """A wanted name equal to the whole (blank-normalised) class attribute or to one of its tokens."""
    tidy = F.trim(F.regexp_replace(cls, r"(?U)\s+", " "))
    return F.coalesce((tidy == wanted) | F.array_contains(F.split(tidy, " "), wanted), F.lit(False))
