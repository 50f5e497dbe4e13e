"""Fields of fetched pages, by expressions that run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings


def meta(html: Column, name: str) -> Column:
    """The content of <meta name="..." content="...">; empty if there is none."""
    return F.regexp_extract(html, rf'<meta\s+name="{name}"\s+content="([^"]*)"', 1)


def count_of(html: Column, what: str, missing: int = -1) -> Column:
    """A number with commas before a word, such as 1,234 Citations."""
    return F.coalesce(strings.number_with_commas(F.nullif(F.regexp_extract(html, rf"([\d,]+)\s+{what}", 1), F.lit(""))), F.lit(missing))


def listed(text: Column) -> Column:
    """Items of a list that is written with ', ' between them; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ", "))


def fields(pages: DataFrame) -> DataFrame:
    """(page_id, url, last_segment, title, lang, n_links, first_link, links) of raw pages."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = pages.withColumn("links", links)
    return rows.select("page_id", "url", strings.id_from_url(F.col("url")).alias("last_segment"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size("links").cast("long").alias("n_links"), F.coalesce(F.get("links", F.lit(0)), F.lit("")).alias("first_link"), "links")


def paper_records(pages: DataFrame) -> DataFrame:
    """Crawled papers: id, title, abstract, publication_year, authors, related_topics, citation_count, reference_count, references. -1 and empty lists
    stand for what a page lacks. A page whose element error-status has the value 404 was not found and has no record."""
    h = F.col("html")
    year = F.coalesce(F.regexp_extract(h, r'citation_publication_date"\s+content="(\d{4})', 1).try_cast("int"), F.lit(-1))
    status = F.regexp_extract(h, r'<[^>]*\bid="error-status"[^>]*>', 0)
    missing = F.regexp_extract(status, r'\bvalue="([^"]*)"', 1) == "404"
    return pages.where(~F.coalesce(missing, F.lit(False))).select(
        strings.id_from_url(F.col("url")).alias("id"),
        meta(h, "citation_title").alias("title"),
        meta(h, "description").alias("abstract"),
        year.alias("publication_year"),
        F.regexp_extract_all(h, F.lit(r'<meta\s+name="citation_author"\s+content="([^"]*)"'), F.lit(1)).alias("authors"),
        listed(F.regexp_extract(h, r'data-topics="([^"]*)"', 1)).alias("related_topics"),
        count_of(h, "Citations").alias("citation_count"),
        count_of(h, "References").alias("reference_count"),
        F.transform(F.regexp_extract_all(h, F.lit(r'data-reference="([^"]*)"'), F.lit(1)), strings.id_from_url).alias("references"),
    )
