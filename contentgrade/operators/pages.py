"""From fetches to parsed pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentgrade.functions import html as H
from contentgrade.functions.text import strip
from contentgrade.operators.barrier import sealed


def usable_fetches(fetches: DataFrame) -> DataFrame:
    """Fetches without an error and with a document."""
    return fetches.filter(
        (F.coalesce("error", F.lit("")) == "") & (F.coalesce("html", F.lit("")) != "")
    )


def fetched_timestamp(fetched_at: Column) -> Column:
    """Epoch seconds to a timestamp, to the microsecond."""
    return F.timestamp_micros(F.round(fetched_at * 1e6).cast("bigint"))


def parse_pages(
    fetches: DataFrame,
    language: str = "it",
    entities: Mapping[str, str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Title, text and metadata of every fetched document, in one narrow stage.

    A filter on the result doesn't repeat the parse.

    Each ``select`` names the columns that the next one reads more than once. ``keep`` lists
    columns of the input to carry along.
    """
    carried = ["url", "html", "fetched_at", *keep]
    visible = fetches.select(*carried, H.visible_html(F.col("html")).alias("visible"))
    found = visible.select(
        *carried,
        H.main_content(F.col("visible")).alias("main"),
        H.title(F.col("visible")).alias("title"),
        H.meta_tags(F.col("visible")).alias("metas"),
        H.first_time_tag(F.col("visible")).alias("time_tag"),
    )
    metas = F.col("metas")
    time_value = H.time_value(F.col("time_tag"))
    raw = found.select(
        *carried,
        H.marked_text(F.col("main")).alias("text"),
        H.marked_text(F.col("title")).alias("title"),
        H.meta_content(metas, "name", "description").alias("description"),
        H.meta_content(metas, "name", "author").alias("author"),
        F.coalesce(H.meta_content(metas, "property", "article:published_time"), time_value).alias(
            "published"
        ),
        F.coalesce(H.meta_content(metas, "property", "article:modified_time"), time_value).alias(
            "modified"
        ),
    )
    attributes = ("description", "author", "published", "modified")
    decoded = raw.select(
        *carried,
        H.decode_entities(F.col("text"), entities).alias("text"),
        H.decode_entities(F.col("title"), entities).alias("title"),
        F.transform(
            F.array(*attributes), lambda value: strip(H.decode_attribute(value, entities))
        ).alias("attributes"),
    )
    cleaned = decoded.select(
        *carried,
        H.joined_text(F.col("text")).alias("text"),
        H.plain_title(F.col("title")).alias("title"),
        *[F.col("attributes")[at].alias(name) for at, name in enumerate(attributes)],
    )
    pages = cleaned.select(
        "url",
        "title",
        "text",
        "html",
        fetched_timestamp(F.col("fetched_at")).alias("fetched_at"),
        F.struct(
            F.lit(language).alias("language"),
            "title",
            "description",
            "published",
            "modified",
            "author",
        ).alias("metadata"),
        *keep,
    )
    return sealed(pages)


def page_metadata(pages: DataFrame) -> DataFrame:
    """The metadata of each page with its url inside the struct."""
    return pages.withColumn("metadata", F.col("metadata").withField("url", F.col("url")))


def parse_quality_flags(pages: DataFrame) -> DataFrame:
    """Flags for pages whose title or text came out empty."""
    return pages.withColumns(
        {
            "missing_title": F.coalesce("title", F.lit("")) == "",
            "missing_text": F.coalesce("text", F.lit("")) == "",
        }
    )
