"""URL expressions. Links resolve against the root of their page's site, as RFC 3986 joins do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name, so a long expression is not repeated wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def site_root(url: Column) -> Column:
    """Scheme and authority, without the closing slash."""
    return F.concat(scheme(url), F.lit("://"), authority(url))


def _remove_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments; a relative path starts at the root and loses empty segments."""
    given = F.split(path, "/")
    below_root = F.concat(F.array(F.lit("")), given)
    inner = F.filter(F.slice(below_root, F.lit(2), F.size(below_root) - 2), lambda s: s != "")
    relative = F.concat(F.array(F.lit("")), inner, F.slice(below_root, -1, 1))

    def step(done: Column, seg: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(seg == "..", up).when(seg == ".", done).otherwise(F.concat(done, F.array(seg)))

    def fold(segments: Column) -> Column:
        done = F.aggregate(segments, F.array().cast("array<string>"), step)
        # A path that ends in a dot segment names a folder.
        last = F.element_at(segments, -1)
        closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(done, closing), "/")

    joined = let(F.when(path.startswith("/"), given).otherwise(relative), fold)
    return let(joined, lambda j: F.when(j.startswith("/"), j).otherwise(F.concat(F.lit("/"), j)))


def _tail(text: Column, mark: str) -> Column:
    """The mark and all after its first occurrence; '' if there is nothing after it."""
    at = F.locate(mark, text)
    rest = F.substring(text, at + 1, F.length(text))
    return F.when((at > 0) & (rest != ""), F.concat(F.lit(mark), rest)).otherwise("")


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def resolve_link(page_url: Column, href: Column) -> Column:
    """Absolute form of ``href``. Common shapes take the first branch; only the rest pays more."""
    root = site_root(page_url)
    simple = href.rlike(r"^/(?!/)[^#?;\x00-\x1f]*$") & ~href.contains("/.")
    clean = F.regexp_replace(F.regexp_replace(href, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    return (
        F.when(simple, F.concat(root, href))
        .when(href == "", F.concat(root, F.lit("/")))
        .otherwise(let(clean, lambda c: _resolve_clean(page_url, href, c)))
    )


def _resolve_clean(page_url: Column, href: Column, clean: Column) -> Column:
    def same_scheme(own: Column) -> Column:
        rest = F.when(own == "", clean).otherwise(F.substring(clean, F.length(own) + 2, F.length(clean)))
        return F.when((own != "") & (own != scheme(page_url)), href).otherwise(
            let(rest, lambda r: let(_split(r), lambda s: _join(page_url, s)))
        )

    return let(scheme(clean), same_scheme)


def _split(rest: Column) -> Column:
    """Path, query and fragment of a reference without its scheme."""
    front = _before(rest, "#")
    return F.struct(
        _before(front, "?").alias("path"), _tail(front, "?").alias("query"), _tail(rest, "#").alias("fragment")
    )


def _join(page_url: Column, s: Column) -> Column:
    other_site = s["path"].rlike("^//[^/]")
    path = F.regexp_replace(s["path"], "^//[^/]*", "")

    def finish(p: Column) -> Column:
        last = F.substring_index(p, "/", -1)
        folders = F.substring(p, F.lit(1), F.length(p) - F.length(last))
        plain = F.concat(folders, _before(last, ";"))
        ending = F.concat(_tail(last, ";"), s["query"], s["fragment"])
        there = F.concat(scheme(page_url), F.lit("://"), F.regexp_extract(s["path"], "^//([^/]*)", 1))
        # A reference of parameters only keeps the root as its path.
        local = let(plain, lambda x: F.when(x == "", "/").otherwise(_remove_dots(x)))
        return F.when(other_site, F.concat(there, plain, ending)).otherwise(
            F.concat(site_root(page_url), local, ending)
        )

    return let(path, finish)


def url_path(url: Column) -> Column:
    """Path part of an absolute URL, without parameters of its last segment."""
    path = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    last = F.substring_index(path, "/", -1)
    folders = F.substring(path, F.lit(1), F.length(path) - F.length(last))
    return F.concat(folders, F.substring_index(last, ";", 1))


def fetchable(url: Column) -> Column:
    return scheme(url).isin("http", "https")
