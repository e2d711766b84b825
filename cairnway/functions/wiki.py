"""Wiki links: classification of tags, URLs, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTICLE_URL = {"wikipedia": r"^https?://en\.wikipedia\.org/wiki/(.+)", "wikivoyage": r"^https?://en\.wikivoyage\.org/wiki/(.+)", "appropedia": r"^https?://(?:www\.)?appropedia\.org/(?:wiki/)?(.+)"}
PUBLIC = {"wikipedia": "https://en.wikipedia.org/wiki/", "wikivoyage": "https://en.wikivoyage.org/wiki/", "wikidata": "https://www.wikidata.org/wiki/", "appropedia": "https://www.appropedia.org/"}


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def quote(text: Column) -> Column:
    """Percent-encoding that leaves ``/:@!$&'()*+,;=`` alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for plain in "/:@!$&'()+,;=":
        out = F.replace(out, F.lit(f"%{ord(plain):02X}"), F.lit(plain))
    return out


def classify(tag: Column, value: Column) -> Column:
    """struct(source, article) of a tag's value, null for what is no link."""
    v = F.trim(value)
    spaced = lambda a: F.replace(a, F.lit(" "), F.lit("_"))
    entity = F.coalesce(F.nullif(F.regexp_extract(v, r"^(Q\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"^https?://(?:www\.)?wikidata\.org/wiki/(Q\d+)", 1), F.lit("")))
    by_url = lambda name: F.nullif(F.regexp_extract(v, ARTICLE_URL[name], 1), F.lit(""))
    by_tag = F.nullif(F.regexp_extract(v, r"^(?:en:)?(.+)$", 1), F.lit(""))
    article = F.when(tag == "wikidata", entity)
    for name in ("wikipedia", "wikivoyage"):
        article = article.when(tag == name, spaced(F.coalesce(unquote(by_url(name)), by_tag)))
    article = article.when(tag == "appropedia", spaced(F.coalesce(unquote(by_url("appropedia")), v)))
    return F.when((F.coalesce(v, F.lit("")) != "") & article.isNotNull(), F.struct(tag.alias("source"), article.alias("article")))


def rewrite(links: DataFrame, cache: DataFrame, base: str) -> DataFrame:
    """(tag, value, ...) -> with url and status: local if cached, else public, else the original value."""
    known = links.withColumn("link", classify(F.col("tag"), F.col("value")))
    known = known.withColumn("source_type", F.col("link.source")).withColumn("article_id", F.col("link.article")).drop("link")
    joined = known.join(cache.select("source_type", "article_id", F.lit(True).alias("cached")), ["source_type", "article_id"], "left")
    public = F.try_element_at(F.create_map(*[F.lit(x) for kv in PUBLIC.items() for x in kv]), F.col("source_type"))
    local = F.concat(F.lit(base), F.col("source_type"), F.lit("/"), quote(F.col("article_id")))
    url = F.when(F.col("cached"), local).when(public.isNotNull(), F.concat(public, quote(F.col("article_id")))).otherwise(F.col("value"))
    status = F.when(F.col("cached"), "local").when(public.isNotNull(), "public").otherwise("original")
    return joined.withColumn("url", url).withColumn("status", status).drop("cached")
