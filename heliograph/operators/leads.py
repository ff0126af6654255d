"""Leads: scraped items, search plans, contact search and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import html
from heliograph.functions.keys import lookup_key, spread_key
from heliograph.functions.text import blank_to_null, js_round, js_trim, truthy

# Fixed value: the scraped fields that are read.
SCRAPED_ITEM_DDL = """title STRING, subTitle STRING, category STRING, categoryName STRING, address STRING,
    phone STRING, phoneUnformatted STRING, website STRING, url STRING, emails ARRAY<STRING>,
    totalScore DOUBLE, reviewsCount DOUBLE"""

# Fixed value: the pages of a site that are searched for an address, in this order.
CONTACT_PATHS = ("", "/contact", "/contact-us")


def normalize_leads(raw: DataFrame, item: str = "item") -> DataFrame:
    """Scraped JSON items to lead fields; other columns are carried along.

    Only a missing key falls through to the next choice, an empty text does not. A rating or count
    that is not a JSON number is dropped, which is how `from_json` reads it.
    """
    p = F.from_json(F.col(item), SCRAPED_ITEM_DDL)
    with_mail = F.filter("_p.emails", lambda e: e.contains("@"))
    return raw.withColumn("_p", p).select(
        *raw.columns,
        F.coalesce("_p.title", "_p.subTitle", F.lit("Unknown")).alias("name"),
        F.get(with_mail, F.lit(0)).alias("email"),
        F.coalesce("_p.phone", "_p.phoneUnformatted").alias("phone"),
        F.col("_p.website").alias("website"),
        F.col("_p.address").alias("address"),
        F.coalesce("_p.categoryName", "_p.category").alias("category"),
        F.col("_p.totalScore").alias("rating"),
        F.col("_p.reviewsCount").cast("bigint").alias("reviews_count"),
        F.col("_p.url").alias("maps_url"),
    )


def has_email() -> Column:
    return truthy(F.col("email"))


def contactable_leads(leads: DataFrame) -> DataFrame:
    """Leads that can be written to."""
    return leads.filter(has_email())


def enrichable_leads(leads: DataFrame) -> DataFrame:
    """Leads without an address but with a site to search."""
    return leads.filter(~has_email() & truthy(F.col("website")))


def lead_count(leads: DataFrame) -> DataFrame:
    """Leads per campaign."""
    return leads.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("leads"))


def normalize_search_plan(plans: DataFrame) -> DataFrame:
    """`(query, location, search_terms, max_results, max_results_hint)` to a plan that can be run."""
    terms = F.slice(
        F.transform(F.filter("search_terms", lambda t: js_trim(t) != ""), js_trim), 1, 5
    )
    wanted = js_round(F.coalesce("max_results", "max_results_hint", F.lit(50)).cast("double"))
    return (
        plans.withColumn("location", F.coalesce(js_trim(blank_to_null(F.col("location"))), F.lit("Unknown")))
        .withColumn(
            "search_terms",
            F.when(F.size(terms) > 0, terms).otherwise(F.array(F.substring(js_trim(F.col("query")), 1, 80))),
        )
        .withColumn("max_results", F.greatest(F.lit(10), F.least(F.lit(200), wanted)).cast("int"))
        .withColumn("per_term", per_term_quota(F.col("max_results"), F.size("search_terms")))
        .drop("max_results_hint")
    )


def per_term_quota(max_results: Column, terms: Column) -> Column:
    share = F.ceil(max_results / F.greatest(F.lit(1), terms))
    return F.greatest(F.lit(5), F.least(F.lit(200), share)).cast("int")


def extract_contact_emails(
    pages: DataFrame,
    paths: Sequence[str] = CONTACT_PATHS,
    other_pages: bool = False,
) -> DataFrame:
    """`(site, path, content)` of a crawl to the best address per site.

    The search of a site ends at the first page with any hit, in the order of `paths`; with
    `other_pages` the rest of the site follows by path. Junk is dropped only after that, so a page
    with nothing but junk hides the pages behind it. The first page is found with `min`, which
    combines inside each task before the shuffle: a site with most of the pages costs no more.
    """
    rank = F.lit(len(paths))
    for i, path in reversed(list(enumerate(paths))):
        rank = F.when(F.col("path") == path, i).otherwise(rank)
    searched = pages if other_pages else pages.filter(F.col("path").isin(*paths))
    hits = searched.select("site", "path", rank.alias("_rank"), html.contact_hits(F.col("content")).alias("hits"))
    first = F.min(F.when(F.size("hits") > 0, F.struct("_rank", "path", "hits"))).alias("page")
    kept = html.drop_junk_addresses(F.col("page.hits"))
    return (
        hits.groupBy("site")
        .agg(first, F.count(F.lit(1)).alias("pages"))
        .select(
            "site",
            "pages",
            F.col("page.path").alias("found_on"),
            F.coalesce(F.size("page.hits"), F.lit(0)).alias("raw_hits"),
            html.best_address(kept).alias("email"),
        )
    )


def enrich_leads(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Leads with the address found on their site (`site`, `email` of the contact search).

    `reason` says why a lead got none. Any number of leads may share a site. Sites are compared in lower
    case; of the addresses of a site in several spellings the first by name is taken.
    """
    found = (
        contacts.filter(F.col("email").isNotNull())
        .groupBy(F.lower("site").alias("site"))
        .agg(F.min("email").alias("_found"))
        .select(lookup_key(F.col("site")).alias("_site"), "_found")
    )
    host = F.when(~has_email(), F.lower(F.try_parse_url(F.col("website"), F.lit("HOST"))))
    enriched = ~has_email() & F.col("_found").isNotNull()
    reason = (
        F.when(has_email(), "already had email")
        .when(~truthy(F.col("website")), "no website to scrape")
        .when(F.col("_found").isNull(), "no email found on website")
    )
    return (
        leads.withColumn("_site", spread_key(F.col("id"), host))
        .join(found, "_site", "left")
        .select(
            *[c for c in leads.columns if c != "email"],
            F.when(enriched, F.col("_found")).otherwise(F.col("email")).alias("email"),
            enriched.alias("enriched"),
            reason.alias("reason"),
        )
    )


def enrichment_report(results: DataFrame) -> DataFrame:
    """Searches attempted and addresses found per campaign, from the leads that were searched."""
    found = F.count_if(F.coalesce("enriched", F.lit(False)))
    return (
        results.groupBy("campaign_id")
        .agg(F.count(F.lit(1)).alias("attempted"), found.alias("found"))
        .withColumn("hit_rate", F.col("found") / F.col("attempted"))
    )
