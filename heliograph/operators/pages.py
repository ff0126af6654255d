"""Published pages and the forms on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.html import first_form_marker, form_markers, is_full_html
from heliograph.functions.keys import lookup_key, spread_key
from heliograph.functions.text import page_slug


def classify_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("full_html", is_full_html(F.col("html_body")))


def normalize_page_slugs(pages: DataFrame) -> DataFrame:
    """New pages with their slug brought into form; pages left without one are refused."""
    return pages.withColumn("slug", page_slug(F.col("slug"))).filter(F.col("slug").isNotNull())


def link_pages_forms(pages: DataFrame, forms: DataFrame) -> DataFrame:
    """Pages that use a form: by their linked slug, exactly, or by a marker, in any case.

    The markers are pulled out of each page once and joined by equality; no page is matched against
    every form.
    """
    by_marker = pages.select(
        F.col("slug").alias("page_slug"), F.explode(form_markers(F.coalesce("html_body", F.lit("")))).alias("_key")
    ).join(forms.select(F.col("slug").alias("form_slug"), F.lower("slug").alias("_key")), "_key")
    by_slug = pages.filter(F.col("linked_form_slug").isNotNull()).select(
        F.col("slug").alias("page_slug"), F.col("linked_form_slug").alias("form_slug")
    ).join(forms.select(F.col("slug").alias("form_slug")), "form_slug", "left_semi")
    return by_marker.select("page_slug", "form_slug").unionByName(by_slug.select("page_slug", "form_slug")).distinct()


def resolve_page_form(pages: DataFrame, forms: DataFrame) -> DataFrame:
    """The form a page shows: the first marker's, else the linked one, if that form exists.

    The marker is found in any case but looked up as it is written.
    """
    known = forms.select(lookup_key(F.col("slug")).alias("_slug"), F.col("title").alias("form_title"))
    wanted = F.coalesce(first_form_marker(F.col("html_body")), "linked_form_slug")
    return (
        pages.select(F.col("slug").alias("page_slug"), wanted.alias("wanted_form"))
        .withColumn("_slug", spread_key(F.col("page_slug"), F.col("wanted_form")))
        .join(known, "_slug", "left")
        .select(
            "page_slug", "wanted_form", "form_title", F.col("form_title").isNotNull().alias("shows_form")
        )
    )
