"""Path expressions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """A file name without its last extension; a name that only starts with dots keeps them."""
    return F.regexp_replace(name, r"(?s)^(.*[^.].*)\.[^.]*$", "$1")


def join_path(folder: Column, name: Column) -> Column:
    bare = (folder == "") | folder.endswith("/")
    return F.when(bare, F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def page_image_path(folder: Column, doc_path: Column, page_num: Column) -> Column:
    base = stem(file_name(doc_path))
    return join_path(folder, F.concat(base, F.lit("_page_"), page_num.cast("string"), F.lit(".png")))


def page_of(path: Column) -> tuple[Column, Column]:
    """(document name, page number) of a page image path; the number is null on other names."""
    pattern = r"(?s)^(.*)_page_([0-9]+)\.png$"
    name = file_name(path)
    doc = F.regexp_extract(name, pattern, 1)
    page = F.regexp_extract(name, pattern, 2).try_cast("int")
    return F.when(page.isNotNull(), doc), page


def canonical_path(path: Column, escaped: bool) -> Column:
    """One spelling for the paths of different sources.

    The image source and ``_metadata.file_path`` percent-escape names (``escaped=True``), the
    binary file source does not. The scheme goes; ``+`` is protected because decoding would
    turn it into a blank.
    """
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:/+", "/")
    if not escaped:
        return bare
    return F.url_decode(F.regexp_replace(bare, r"\+", "%2B"))
