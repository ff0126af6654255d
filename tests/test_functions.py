"""Scalar rules on hand-made rows."""

import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from heliograph.functions import html, text, tokens


def value(spark, column, **inputs):
    schema = ", ".join(
        f"{k} {'string' if not isinstance(v, (int, float)) or isinstance(v, bool) else 'double'}" for k, v in inputs.items()
    ) or "_ string"
    row = tuple(inputs.values()) or (None,)
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "raw, slug",
    [("--Ab c!!", "ab-c"), ("Ann's Bot", "ann-s-bot"), ("x" * 31 + "--y", "x" * 31 + "-"), ("!!", "")],
)
def test_slugify(spark, raw, slug):
    assert value(spark, text.slugify(F.col("c")), c=raw) == slug


@pytest.mark.parametrize("raw, slug", [("  Team Size! ", "team_size"), ("__a__b__", "a__b"), ("É", "")])
def test_field_slug(spark, raw, slug):
    assert value(spark, text.field_slug(F.col("c")), c=raw) == slug


@pytest.mark.parametrize("raw, slug", [(" My Page/1 ", "my-page-1"), ("--a--", "a"), ("!!", None)])
def test_page_slug(spark, raw, slug):
    assert value(spark, text.page_slug(F.col("c")), c=raw) == slug


@pytest.mark.parametrize(
    "age, shown",
    [(None, "never"), (0, "0s ago"), (59.9, "59s ago"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (25 * 3600, "1d ago")],
)
def test_time_ago(spark, age, shown):
    now = datetime.datetime(2024, 1, 10)
    then = None if age is None else now - datetime.timedelta(seconds=age)
    df = spark.createDataFrame([(then, now)], "t timestamp, n timestamp")
    assert df.select(text.time_ago(F.col("t"), F.col("n"))).first()[0] == shown


@pytest.mark.parametrize("x, rounded", [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0)])
def test_js_round(spark, x, rounded):
    assert value(spark, text.js_round(F.col("c")), c=x) == rounded


def test_js_trim_takes_all_whitespace(spark):
    assert value(spark, text.js_trim(F.col("c")), c="﻿  \t x y \n") == "x y"
    assert value(spark, text.js_trim(F.col("c")), c=" \n") == ""


@pytest.mark.parametrize(
    "raw, masked",
    [(None, ""), ("", ""), ("a" * 10, "•" * 10), ("abcd1234wxyz", "abcd••••wxyz"), ("abcdefghijk", "abcd••••hijk"), ("a" * 20, "aaaa" + "•" * 12 + "aaaa")],
)
def test_mask_secret(spark, raw, masked):
    assert value(spark, text.mask_secret(F.col("c")), c=raw) == masked


def test_mask_all_but_last4(spark):
    assert value(spark, text.mask_all_but_last4(F.col("c")), c="abcdefgh") == "••••efgh"
    assert value(spark, text.mask_all_but_last4(F.col("c")), c="abc") == "abc"


@pytest.mark.parametrize("seconds, shown", [(5, "5s"), (60, "1m 0s"), (125, "2m 5s")])
def test_format_duration(spark, seconds, shown):
    df = spark.createDataFrame([(seconds,)], "c bigint")
    assert df.select(text.format_duration(F.col("c"))).first()[0] == shown


def test_names(spark):
    assert value(spark, text.sanitize_display_name(F.col("c")), c=' "Ann\r\n Lee" ') == "Ann Lee"
    assert value(spark, text.default_name(F.col("n"), F.col("e")), n="", e="jo@x.test") == "jo"
    assert value(spark, text.default_name(F.col("n"), F.col("e")), n="Jo", e="jo@x.test") == "Jo"


def test_json_and_map_access(spark):
    assert value(spark, text.json_path(F.col("c"), "$.a"), c='{"a":"x"}') == "x"
    assert value(spark, text.json_path(F.col("c"), "$.a"), c='{"a":""}') is None
    assert value(spark, text.json_path(F.col("c"), "$.a"), c="broken") is None
    got = spark.sql("SELECT map('a', '', 'b', 'x') AS m").select(
        text.map_get(F.col("m"), "a"), text.map_get(F.col("m"), "b"), text.map_get(F.col("m"), "c")
    ).first()
    assert tuple(got) == (None, "x", None)


def test_strip_code_fences(spark):
    for raw in ("```json\n{}\n```", "```JSON {} ```  \n", "``` {}```", "{}"):
        assert value(spark, text.strip_code_fences(F.col("c")), c=raw) == "{}"


def test_html_escape(spark):
    assert value(spark, html.html_escape(F.col("c")), c="<a href=\"x\">'&amp;") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;"


@pytest.mark.parametrize(
    "raw, full",
    [("\n\t <!DOCTYPE html><p>", True), ("<HTML>", True), ("<div><html>", False), ("", False), (" <html>", True)],
)
def test_is_full_html(spark, raw, full):
    assert value(spark, html.is_full_html(F.col("c")), c=raw) is full


def test_click_token_round_trip(spark):
    url = "https://x.test/?q=" + "é~?>" * 60
    packed = value(
        spark, tokens.encode_click_token(F.lit("c"), F.lit("l"), F.lit("e"), F.col("u")), u=url
    )
    assert not set(packed) & set("+/=\r\n")
    assert json.loads(base64.urlsafe_b64decode(packed + "=" * (-len(packed) % 4))) == {"c": "c", "l": "l", "e": "e", "u": url}
    assert value(spark, tokens.decode_click_token(F.col("t"))["u"], t=packed) == url


@pytest.mark.parametrize("token", ["!!!", "", "bm90IGpzb24"])
def test_broken_click_tokens(spark, token):
    assert value(spark, tokens.decode_click_token(F.col("t"))["u"], t=token) is None


def test_rewrite_links(spark):
    base = "https://t.test"
    same = f'<a href="#top"></a><a href="mailto:a@b"></a><a href="TEL:1"></a><a href="sms:1"></a><a href="{base}/t/x"></a><a href=\'x\'></a>'
    run = html.rewrite_links(F.col("c"), base, F.lit("1"), F.lit("2"), F.lit("3"))
    assert value(spark, run, c=same) == same
    assert value(spark, run, c="plain") == "plain"
    out = value(spark, run, c='a<a HREF="u1">b</a> data-href="u2"')
    parts = out.split('href="')
    assert len(parts) == 3 and parts[0] == "a<a " and out.endswith('"')
    for part, url in zip(parts[1:], ("u1", "u2")):
        token = part.split('"')[0].removeprefix(f"{base}/t/")
        assert json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))) == {"c": "1", "l": "2", "e": "3", "u": url}


def test_bodies(spark):
    col = html.default_body_html(F.col("h"), F.col("t"))
    assert value(spark, col, h=" ", t="a\nb") == "<p>a</p><p>b</p>"
    assert value(spark, col, h=None, t="a") == "<p>a</p>"
    assert value(spark, col, h="<b>", t="a") == "<b>"
    sent = html.outbound_html(F.col("h"), F.col("t"))
    assert value(spark, sent, h="", t="a\nb") == "<p>a\nb</p>"
    assert value(spark, sent, h=None, t=None) == "<p></p>"


@pytest.mark.parametrize(
    "raw, ok",
    [('{"a":1}', True), (' [1] \n', True), ("7", True), ("null", True), ('{"a":1,"a":2}', True), ("", False), (None, False),
     ('{"a":1} x', False), ('{"a":1}]', False), ('{"a":1}}', False), ("1,2", False), ("{'a':1}", False), ("{a:1}", False), ("NaN", False)],
)
def test_strict_json(spark, raw, ok):
    from heliograph.functions.json import is_json

    assert value(spark, is_json(F.col("c")), c=raw) is ok


def test_sign_in_name(spark):
    col = text.sign_in_name(F.col("n"), F.col("r"), F.col("i"))
    assert value(spark, col, n="My Bot", r="", i="abcdef") == "my-bot-abcd"
    assert value(spark, col, n="My Bot", r="Bo", i="abcdef") == "bo-abcd"
