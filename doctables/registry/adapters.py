"""Frames in the shapes the operators take, derived from the given tables by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_QUERIES = 9
IMG_W, IMG_H = 1700, 2600


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def image_path(vec_id: Column) -> Column:
    doc = F.floor(vec_id / 10).cast("string")
    page = (vec_id % 10 + 1).cast("string")
    return F.concat(F.lit("out/Doc, "), doc, F.lit("_page_"), page, F.lit(".png"))


def raw_outputs(spark: SparkSession, sf: str, small: bool = False) -> DataFrame:
    """Model output of one page image per vector: 9 queries of 3 logits and a box.

    Every seventh page shows nothing but "no object"; the 64th value makes the last box higher.
    ``small`` pages are the 8 x 8 gray images and carry them.
    """
    emb = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.transform("embedding", _level).alias("g")
    )
    size = (8, 8) if small else (IMG_W, IMG_H)
    image = [_image(8, 8, 1, F.col("g")).alias("image")] if small else []
    starts = [7 * q for q in range(N_QUERIES)]
    empty = "CASE WHEN vec_id % 7 = 3 THEN 100.0D ELSE 0.0D END"
    logits = ", ".join(f"array(v[{s}] * 10, v[{s + 1}] * 10, v[{s + 2}] * 10 + {empty})" for s in starts)
    more = {starts[-1]: " + abs(v[63])"}
    boxes = ", ".join(
        f"array(v[{s + 3}] + 0.5D, v[{s + 4}] + 0.5D, abs(v[{s + 5}]), abs(v[{s + 6}]){more.get(s, '')})" for s in starts
    )
    return emb.select(
        "vec_id",
        image_path(F.col("vec_id")).alias("file_path"),
        F.expr(f"array({logits})").alias("logits"),
        F.expr(f"array({boxes})").alias("boxes"),
        F.lit(size[0]).alias("img_w"),
        F.lit(size[1]).alias("img_h"),
        *image,
    )


def _bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda g: F.lpad(F.hex(g), 2, "0")), ""))


def _level(value: Column) -> Column:
    return F.least(F.greatest(F.floor((value.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", _level).alias("g"))


def _image(height: int, width: int, channels: int, values: Column) -> Column:
    return F.struct(
        F.lit("").alias("origin"),
        F.lit(height).alias("height"),
        F.lit(width).alias("width"),
        F.lit(channels).alias("nChannels"),
        F.lit(0 if channels == 1 else 16).alias("mode"),
        _bytes(values).alias("data"),
    )


def gray_images(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 gray images, one per vector."""
    return _levels(spark, sf).select("vec_id", _image(8, 8, 1, F.col("g")).alias("image"))


def faulty_images(spark: SparkSession, sf: str) -> DataFrame:
    """The gray images, of which every seventh lacks its last row and every eleventh did not decode."""
    cut = _image(7, 8, 1, F.slice("g", 1, 56))
    none = F.struct(F.lit("").alias("origin"), *[F.lit(-1).alias(n) for n in ("height", "width", "nChannels", "mode")], F.lit(b"").alias("data"))
    i = F.col("vec_id")
    image = F.when(i % 11 == 0, none).when(i % 7 == 0, cut).otherwise(_image(8, 8, 1, F.col("g")))
    return _levels(spark, sf).select("vec_id", image.alias("image"))


def color_images(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 images of three channels in stored order, one per vector: its values three times over."""
    return _levels(spark, sf).select("vec_id", _image(8, 8, 3, F.flatten(F.array_repeat("g", 3))).alias("image"))


def catalog_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows as read from CSV text, with an unusable id on every 97th."""
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.when(doc % 97 == 0, F.concat(F.lit("n/a "), doc.cast("string")))
        .otherwise(doc.cast("string"))
        .alias("Publication ID"),
        publication_url(doc).alias("URL"),
    )


def publication_url(doc_id: Column) -> Column:
    return F.concat(F.lit("https://pubs.example.org/publication/"), doc_id.cast("string"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        doc.alias("publication_id"), publication_url(doc).alias("url")
    )


def obtained_files(spark: SparkSession, sf: str) -> DataFrame:
    """Downloaded file names, every 50th without a usable id."""
    doc = F.col("doc_id")
    name = F.concat(F.when(doc % 50 == 0, "x").otherwise(""), doc.cast("string"), F.lit(".pdf"))
    return table(spark, sf, "labels").select(name.alias("file_name")).distinct()


def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """A mixed folder listing with a processing status per file."""
    doc = F.col("doc_id")
    kind = doc % 4
    prefix = F.when(kind == 0, "sample_").when(kind == 1, "Sample ").otherwise("")
    ext = F.when(kind == 3, ".png").otherwise(".pdf")
    return table(spark, sf, "documents").select(
        F.concat(prefix, doc.cast("string"), ext).alias("file_name"),
        F.concat(F.lit("in/"), F.col("lang")).alias("folder"),
        F.when(doc % 17 == 0, "error").otherwise("ok").alias("status"),
    )


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a page count and a page size."""
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("Doc, "), doc.cast("string")).alias("doc"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 2000.0)).cast("int").alias("n_pages"),
        (doc % 2000 + 600).cast("int").alias("width"),
        (doc % 1700 + 800).cast("int").alias("height"),
    )


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per page of ``doc_pages``, with the page's image path."""
    pages = doc_pages(spark, sf).withColumn("page_num", F.explode(F.sequence(F.lit(1), F.col("n_pages"))))
    name = F.concat(F.lit("out/"), F.col("doc"), F.lit("_page_"), F.col("page_num").cast("string"), F.lit(".png"))
    return pages.withColumn("image_path", name)


def landed_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", "html")


def crawl_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("publication_id"), "url")


def repeated_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog with places, where every fifth row comes twice and every third page is also named
    under the next publication's id."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    i = F.col("page_id")

    def rows(some: DataFrame, publication: Column, place: int) -> DataFrame:
        return some.select(publication.alias("publication_id"), "url", (i * 4 + place).alias("catalog_pos"))

    return (
        rows(pages, i, 0)
        .unionByName(rows(pages.filter(i % 5 == 0), i, 1))
        .unionByName(rows(pages.filter(i % 3 == 0), i + 1, 2))
    )


def landed_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Landed pages with their fetch time; every fifth also as an older copy with one link, and as a
    newer copy without any."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html", F.lit(2).alias("fetched_at"))
    some = pages.filter(F.col("page_id") % 5 == 0)
    older = some.withColumns({"html": F.lit('<a href="/old">x</a>'), "fetched_at": F.lit(1)})
    newer = some.withColumns({"html": F.lit("<p>Try again later</p>"), "fetched_at": F.lit(3)})
    return pages.unionByName(older).unionByName(newer).drop("page_id")


def group_files(spark: SparkSession, sf: str) -> DataFrame:
    """A file per fifty vectors: their ids, in folders by two rules; every fourth file is empty."""
    g = F.col("g")
    groups = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("g")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    folder = F.concat(F.lit("n"), (g % 25).cast("string"), F.lit("/"), (g % 10).cast("string"))
    name = F.concat(folder, F.lit("/Group, "), g.cast("string"), F.when(g % 3 == 0, ".txt").otherwise(".pdf"))
    text = F.when(g % 4 != 0, F.array_join(F.col("ids").cast("array<string>"), ",")).otherwise("")
    return groups.select(name.alias("name"), F.encode(text, "UTF-8").alias("content"))


def bitmap_files(spark: SparkSession, sf: str) -> DataFrame:
    """An uncompressed image of 4 x 2 pixels per fifty vectors; every ninth file is no image."""
    g = F.col("g")
    groups = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 50).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    # Headers of a bitmap file with 24 bits a pixel and rows from the bottom up.
    header = "424D" + "4E000000" + "00000000" + "36000000" + "28000000" + "04000000" + "02000000" + "01001800" + "00000000" + "18000000" + "00" * 16
    shades = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.lpad(F.hex((g + F.col("n") + i) % 256), 2, "0"))
    image = F.unhex(F.concat(F.lit(header), F.array_join(shades, "")))
    name = F.concat(F.lit("Doc, "), F.floor(g / 10).cast("string"), F.lit("_page_"), (g % 10 + 1).cast("string"), F.lit(".bmp"))
    return groups.select(name.alias("name"), F.when(g % 9 == 0, F.encode(F.lit("no image"), "UTF-8")).otherwise(image).alias("content"))
