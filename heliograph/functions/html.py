"""Expressions over HTML: links, markers, escaping and contact addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions.text import js_trim, js_trim_start
from heliograph.functions.tokens import encode_click_token

# --- fixed values: patterns that decide which addresses and links count ---------------------------
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MAILTO_PATTERN = r"""(?i)mailto:([^"'?\s>]+)"""
WELL_FORMED = r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$"
IMAGE_NAME = r"(?i)\.(png|jpg|jpeg|gif|webp|svg|ico)$"
JUNK_LOCAL_PART = r"(?i)^(example|sentry|wixpress|wix|youremail|test)@"
JUNK_HOST = r"(?i)\.(example|wixsite|sentry)\."
ROLE_MAILBOX = (
    r"(?i)^(info|contact|hello|hi|admin|sales|office|reception|enquiries|inquiries|support)@"
)
HREF_PATTERN = r'(?i)href="[^"]+"'
UNTRACKED_LINK = r"(?i)^(#|mailto:|tel:|sms:)"
FORM_MARKER = r"(?i)\{\{form:([a-z0-9-]+)\}\}"
ANY_FORM_MARKER = r"(?i)\{\{form:((?:(?!\{\{form:).)+?)\}\}"
# ---------------------------------------------------------------------------------------------------


def html_escape(c: Column) -> Column:
    for raw, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"),
    ):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def is_full_html(c: Column) -> Column:
    """True for a complete document, false for a body fragment."""
    head = F.lower(F.substring(js_trim_start(c), 1, 300))
    return head.startswith("<!doctype") | head.startswith("<html")


def first_form_marker(c: Column) -> Column:
    """Slug of the first form marker as written; null without one."""
    return F.nullif(F.regexp_extract(c, FORM_MARKER, 1), F.lit(""))


def form_markers(c: Column) -> Column:
    """All distinct marker slugs in lower case. A form's slug is free text, so any text counts, but a
    marker that is not closed ends where the next one begins."""
    found = F.regexp_extract_all(c, F.lit(ANY_FORM_MARKER), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def contact_hits(c: Column) -> Column:
    """Addresses on one page: `mailto:` targets first, then plain ones, lower case, in order.

    Most texts hold neither, which a substring search tells far faster than the patterns do.
    """
    mailto = F.regexp_extract_all(c, F.lit(MAILTO_PATTERN), F.lit(1))
    plain = F.regexp_extract_all(c, F.lit(EMAIL_PATTERN), F.lit(0))
    none = F.array().cast("array<string>")
    found = F.concat(
        F.when(F.lower(c).contains("mailto:"), mailto).otherwise(none),
        F.when(c.contains("@"), plain).otherwise(none),
    )
    return F.array_distinct(F.transform(found, lambda a: js_trim(F.lower(a))))


def drop_junk_addresses(addresses: Column) -> Column:
    """Keep well-formed addresses that are neither image names nor placeholders."""
    return F.filter(
        addresses,
        lambda a: a.rlike(WELL_FORMED)
        & ~a.rlike(IMAGE_NAME)
        & ~a.rlike(JUNK_LOCAL_PART)
        & ~a.rlike(JUNK_HOST),
    )


def best_address(addresses: Column) -> Column:
    """The first shared mailbox, else the first address."""
    shared = F.filter(addresses, lambda a: a.rlike(ROLE_MAILBOX))
    return F.coalesce(F.get(shared, F.lit(0)), F.get(addresses, F.lit(0)))


def rewrite_links(
    html: Column, base_url: str, campaign_id: Column, lead_id: Column, email_id: Column
) -> Column:
    """Send every double-quoted `href` through the click tracker, leaving the rest as it is.

    The text is cut at the links and put together again, so one pass of built-in functions does
    it: n links give n + 1 pieces, and piece i is followed by the new form of link i.
    """
    pieces = F.split(html, HREF_PATTERN, -1)
    links = F.regexp_extract_all(html, F.lit(HREF_PATTERN), F.lit(0))
    tracker = f"{base_url}/t/"

    def tracked(link: Column) -> Column:
        url = F.substr(link, F.lit(7), F.length(link) - 7)
        skip = url.rlike(UNTRACKED_LINK) | url.startswith(tracker)
        token = encode_click_token(campaign_id, lead_id, email_id, url)
        return F.when(skip, link).otherwise(F.concat(F.lit(f'href="{tracker}'), token, F.lit('"')))

    return F.array_join(
        F.zip_with(
            pieces,
            F.transform(links, tracked),
            lambda piece, link: F.concat(piece, F.coalesce(link, F.lit(""))),
        ),
        "",
    )


def default_body_html(body_html: Column, body_text: Column) -> Column:
    """The HTML body, or the text with its lines as paragraphs when there is none."""
    paragraphs = F.concat(
        F.lit("<p>"), F.replace(body_text, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")
    )
    return F.when(js_trim(body_html) != "", body_html).otherwise(paragraphs)


def outbound_html(body_html: Column, body_text: Column) -> Column:
    """The body that is sent: the HTML, or the text in a single paragraph."""
    return F.when(F.coalesce(body_html, F.lit("")) != "", body_html).otherwise(
        F.concat(F.lit("<p>"), F.coalesce(body_text, F.lit("")), F.lit("</p>"))
    )
