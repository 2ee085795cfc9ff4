"""Document links of crawled publication pages, and the download plans made from them.

Page bodies are the bulk of the data. They are reduced to link lists where they are read and never
take part in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions import html as H
from doctables.functions import paths, urls
from doctables.functions.rows import explode_list
from doctables.operators.lookup import lookup_join

# Fixed value: class of the anchors that lead to a publication's files.
DOCUMENT_CLASS = "usa-link Document"
# Bits of the set of wanted URLs, 64 to a row: at most 2^18 rows, however long the catalog is.
WANTED_BITS = 1 << 24


def page_hrefs(pages: DataFrame, class_name: str | None = None, html: str = "html") -> DataFrame:
    """Replace the page body by ``hrefs``: the link targets of one class in page order."""
    keys = [c for c in pages.columns if c != html]
    tokens = pages.select(*keys, F.col(html).alias("_html"), H.anchor_tokens(F.col(html)).alias("_tokens"))
    split = tokens.select(*keys, H.for_parser(F.col("_html"), F.col("_tokens")).alias("_markup"), "_tokens")
    parsed = split.select(*keys, H.parsed_anchors(F.col("_markup")).alias("_parsed"), "_tokens")
    anchors = F.coalesce(F.col("_parsed"), H.strict_anchors(F.col("_tokens")))
    found = parsed.select(*keys, anchors.alias("_anchors"))
    wanted = F.col("_anchors")
    if class_name is not None:
        wanted = F.filter(wanted, lambda a: H.class_matches(a["cls"], class_name))
    return found.select(*keys, F.transform(wanted, lambda a: a["href"]).alias("hrefs"))


def extract_links(pages: DataFrame, class_name: str | None = None) -> DataFrame:
    """One row per link: the page's keys, ``link_pos`` from 0, ``href`` as written."""
    found = page_hrefs(pages, class_name)
    keys = [c for c in found.columns if c != "hrefs"]
    return explode_list(found, F.col("hrefs"), "link_pos", "href", keys)


def resolve_links(links: DataFrame, page_url: str = "url", href: str = "href") -> DataFrame:
    return links.withColumn("link_url", urls.resolve_link(F.col(page_url), F.col(href)))


def page_lists(pages: DataFrame, class_name: str | None = DOCUMENT_CLASS) -> DataFrame:
    """One link list per URL.

    Of several landed copies of a page the newest by ``fetched_at`` (where there is one) that has
    links gives the list; of equally new ones the fullest. A copy without links never hides another.
    Bodies become lists where they are read, and copies combine map-side before the shuffle.
    """
    fetched = ["fetched_at"] if "fetched_at" in pages.columns else []
    lists = page_hrefs(pages.select("url", *fetched, "html"), class_name)
    best = F.max(F.struct((F.size("hrefs") > 0).alias("some"), *fetched, F.size("hrefs").alias("n"), "hrefs"))
    return lists.groupBy("url").agg(best.alias("_best")).select("url", F.col("_best.hrefs").alias("hrefs"))


def wanted_pages(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """Landed pages that the catalog may name, before their bodies are read any further.

    A semi-join with a bitmap of the catalog's hashed URLs. Its size is bounded, so it is broadcast
    and page bodies do not move; the catalog may be of any length. A page that only shares its bit
    with a wanted one passes, which the join by URL corrects. Rows without a URL name no page.
    """

    def place(url: Column) -> Column:
        return F.xxhash64(url).bitwiseAND(F.lit(WANTED_BITS - 1).cast("long"))

    named = catalog.filter(F.col("url").isNotNull()).select(place(F.col("url")).alias("_place"))
    word, bit = F.shiftright("_place", 6), F.col("_place").bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = named.groupBy(word.alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits"))
    placed = pages.filter(F.col("url").isNotNull()).withColumn("_place", place(F.col("url")))
    there = (word == F.col("_word")) & (F.getbit("_bits", bit) == 1)
    return placed.join(F.broadcast(bits), there, "left_semi").drop("_place")


def catalog_links(
    catalog: DataFrame, pages: DataFrame, class_name: str | None = DOCUMENT_CLASS, skew: bool = False
) -> DataFrame:
    """(publication, link) rows for every catalog row whose page was fetched.

    Only pages that the catalog names are parsed. All columns of the catalog stay; a seed list without ``publication_id`` will do. ``skew`` is for
    catalogs that name one page very often.
    """
    keys = catalog.columns
    lists = page_lists(wanted_pages(catalog, pages), class_name)
    pairs = lookup_join(catalog, lists, "url", "inner", skew=skew)
    return resolve_links(explode_list(pairs, F.col("hrefs"), "link_pos", "href", keys))


def _order(links: DataFrame) -> Column:
    """Position in which links are fetched: catalog order where it is known, then page order."""
    first = [c for c in ("catalog_pos",) if c in links.columns]
    return F.struct(*first, "link_pos")


def _pdf_name() -> Column:
    return F.concat(F.col("publication_id").cast("string"), F.lit(".pdf"))


def download_plan_by_id(links: DataFrame) -> DataFrame:
    """One file ``<publication id>.pdf`` per publication; the last fetchable link wins.

    Catalogs that name a publication more than once need ``catalog_pos``: without it the rows of one
    id have no order among each other.
    """
    usable = links.filter(urls.fetchable(F.col("link_url")))
    winner = usable.groupBy("publication_id").agg(
        F.max(F.struct(_order(usable).alias("at"), F.col("link_url"))).alias("_last"),
        F.count(F.lit(1)).alias("n_links"),
    )
    return winner.select(
        "publication_id",
        F.col("_last.at.link_pos").alias("link_pos"),
        F.col("_last.link_url").alias("link_url"),
        _pdf_name().alias("file_path"),
        "n_links",
    )


def download_candidates(links: DataFrame) -> DataFrame:
    """Per publication all fetchable links, the last one first: the order in which they decide."""
    usable = links.filter(urls.fetchable(F.col("link_url")))
    one = F.struct(_order(usable).alias("at"), F.col("link_url"))
    listed = usable.groupBy("publication_id").agg(F.sort_array(F.collect_list(one), asc=False).alias("_links"))
    return listed.select(
        "publication_id",
        _pdf_name().alias("file_path"),
        F.transform("_links", lambda x: F.struct(x["at"]["link_pos"].alias("link_pos"), x["link_url"].alias("link_url"))).alias("links"),
    )


def candidate_links(links: DataFrame) -> DataFrame:
    """The rows of ``download_candidates`` one by one, for publications with any number of links.

    ``position`` is largest for the link to try first, and ``first_url`` is that link.
    """
    usable = links.filter(urls.fetchable(F.col("link_url"))).withColumn("position", _order(links))
    first = usable.groupBy(F.col("publication_id").alias("_id")).agg(F.max_by("link_url", F.struct("position", "link_url")).alias("first_url"))
    return usable.join(first, F.col("publication_id").eqNullSafe(F.col("_id"))).select(
        "publication_id", _pdf_name().alias("file_path"), F.col("position.link_pos").alias("link_pos"), "link_url", "position", "first_url"
    )


def overwritten_links(links: DataFrame) -> DataFrame:
    """Links that lose their file to a later one, told by their position.

    Only the largest position of each publication is grouped and joined back.
    """
    usable = links.filter(urls.fetchable(F.col("link_url"))).withColumn("_at", _order(links))
    last = usable.groupBy("publication_id").agg(F.max("_at").alias("_last"))
    return usable.join(last, "publication_id").filter("_at < _last").drop("_at", "_last")


def download_plan_by_path(links: DataFrame) -> DataFrame:
    """One file per URL path; of links with the same path the last one wins.

    The order is that of the catalog where it is known, else that of publication ids.
    """
    usable = links.filter(urls.fetchable(F.col("link_url"))).withColumn(
        "file_path", F.regexp_replace(urls.url_path(F.col("link_url")), "^/+", "")
    )
    first = [] if "catalog_pos" in links.columns else [c for c in ("publication_id",) if c in links.columns]
    at = F.struct(*first, _order(usable).alias("at"), F.col("link_url").alias("u"))
    last = usable.groupBy("file_path").agg(F.max(at).alias("_last"), F.count(F.lit(1)).alias("n_links"))
    return last.select("file_path", F.col("_last.u").alias("link_url"), "n_links")


def expected_files(catalog: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """Expected PDF path of every catalog row, and whether the listing has it."""
    name = F.concat(F.col("publication_id").cast("string"), F.lit(".pdf"))
    wanted = catalog.withColumn("file_name", name).withColumn(
        "pdf_path", paths.join_path(F.lit(folder), F.col("file_name"))
    )
    there = listing.select("file_name").distinct().withColumn("_there", F.lit(True))
    return (
        lookup_join(wanted, there, "file_name", "left")
        .withColumn("present", F.coalesce(F.col("_there"), F.lit(False)))
        .drop("_there", "file_name")
    )
