"""Click tokens: `{c, l, e, u}` as JSON in unpadded base64url."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliograph.functions.json import is_json

TOKEN_DDL = "c STRING, l STRING, e STRING, u STRING"


def encode_click_token(campaign_id: Column, lead_id: Column, email_id: Column, url: Column) -> Column:
    payload = F.to_json(
        F.struct(
            campaign_id.cast("string").alias("c"),
            lead_id.cast("string").alias("l"),
            email_id.cast("string").alias("e"),
            url.alias("u"),
        )
    )
    # base64() breaks its output into lines of 76 characters.
    packed = F.regexp_replace(F.base64(F.encode(payload, "UTF-8")), r"[\r\n=]", "")
    return F.translate(packed, "+/", "-_")


def token_characters(token: Column) -> Column:
    """A token's characters of the standard alphabet. Those outside the alphabet are skipped."""
    # No underscore is left for \w, which Java finds sooner than three ranges.
    return F.regexp_replace(F.translate(token, "-_", "+/"), r"[^\w+/]+", "")


def token_text(kept: Column) -> Column:
    """The text that these characters stand for. An odd one at the end holds no whole byte and is skipped."""
    whole = F.substring(kept, F.lit(1), F.length(kept) - F.when(F.length(kept) % 4 == 1, 1).otherwise(0))
    raw = F.try_to_binary(whole, F.lit("base64"))
    return F.make_valid_utf8(raw.cast("string"))


def token_payload(text: Column) -> Column:
    """The payload struct; null when the text is not a JSON object."""
    return F.when(is_json(text), F.from_json(text, TOKEN_DDL))


def decode_click_token(token: Column) -> Column:
    """The payload struct; null when the token is not base64url of a JSON object. Over tables the steps
    belong in columns of their own, as in `sources.ingest`: here each is written out at each of its uses."""
    return token_payload(token_text(token_characters(token)))
