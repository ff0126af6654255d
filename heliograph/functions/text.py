"""Text, number and time expressions with the rounding and trimming rules of the source system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a web client counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def js_trim(c: Column) -> Column:
    """Strip all whitespace from both ends; Spark's `trim` strips only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def js_trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Null for null, empty or all-white text."""
    return F.when(js_trim(c) != "", c)


def truthy(c: Column) -> Column:
    """True when the text is neither null nor empty; never null."""
    return F.coalesce(c != "", F.lit(False))


def js_round(c: Column) -> Column:
    """Round half up towards plus infinity; Spark's `round` goes away from zero."""
    return F.floor(c + F.lit(0.5))


def slugify(c: Column) -> Column:
    """Sign-in slug: one leading and one trailing dash go, and then 32 characters are kept."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-|-\z", ""), 1, 32)


def sign_in_name(name: Column, requested: Column, agent_id: Column) -> Column:
    """Unique sign-in name of an agent: the slug and the start of its id."""
    wanted = F.when(truthy(requested), requested).otherwise(name)
    return F.concat(slugify(wanted), F.lit("-"), F.left(agent_id, F.lit(4)))


def field_slug(c: Column) -> Column:
    """Name of a form field: letters, digits and underscores."""
    return F.regexp_replace(
        F.regexp_replace(js_trim(F.lower(c)), "[^a-z0-9_]+", "_"), r"^_+|_+\z", ""
    )


def page_slug(c: Column) -> Column:
    """Slug of a published page; null when nothing is left of it."""
    slug = F.regexp_replace(
        F.regexp_replace(js_trim(F.lower(c)), "[^a-z0-9-]+", "-"), r"^-+|-+\z", ""
    )
    return F.nullif(slug, F.lit(""))


def time_ago(ts: Column, now: Column) -> Column:
    """`never`, `42s ago`, `3m ago`, `5h ago` or `2d ago`, rounding down at each level."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1_000_000)
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    return (
        F.when(ts.isNull(), "never")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def format_duration(seconds: Column) -> Column:
    """`2m 5s`, or `5s` below a minute."""
    minutes = F.floor(seconds / 60)
    rest = F.concat((seconds % 60).cast("string"), F.lit("s"))
    return F.when(
        minutes != 0, F.concat(minutes.cast("string"), F.lit("m "), rest)
    ).otherwise(rest)


def sanitize_display_name(c: Column) -> Column:
    """Sender name that is safe in a mail header."""
    return js_trim(F.regexp_replace(c, r'["\r\n]', ""))


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def default_name(name: Column, email: Column) -> Column:
    """The given name, or the part of the address before `@`."""
    return F.when(truthy(name), name).otherwise(local_part(email))


def mask_secret(c: Column) -> Column:
    """Dots only up to ten characters, else the first and last four around at least four dots."""
    n = F.length(c)
    dots = F.repeat(F.lit("•"), F.greatest(F.lit(4), n - 8))
    return (
        F.when(~truthy(c), "")
        .when(n <= 10, F.repeat(F.lit("•"), n))
        .otherwise(F.concat(F.left(c, F.lit(4)), dots, F.right(c, F.lit(4))))
    )


def mask_all_but_last4(c: Column) -> Column:
    return F.regexp_replace(c, r".(?=.{4})", "•")


def json_path(c: Column, path: str) -> Column:
    """One value of a JSON text by path; null when absent or empty."""
    return F.nullif(F.get_json_object(c, path), F.lit(""))


def map_get(c: Column, key: Column | str) -> Column:
    """Value of a map key; null when absent or empty."""
    return F.nullif(F.try_element_at(c, F.lit(key) if isinstance(key, str) else key), F.lit(""))


def strip_code_fences(c: Column) -> Column:
    """Drop a leading and trailing Markdown code fence."""
    opened = js_trim(F.when(c.startswith("```"), F.regexp_replace(c, r"\A```(?i:json)?", "")).otherwise(c))
    return js_trim(F.when(opened.endswith("```"), F.left(opened, F.length(opened) - 3)).otherwise(opened))
