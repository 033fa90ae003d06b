from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.functions import web


def values(spark, rows, column):
    schema = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_collapse(spark):
    """All runs of three of these characters, as by hand: other white space than a space becomes one even if it stands alone."""
    some = [" ", "a", "~", "!", "\t", "\x0b", "\x1f", "\x7f", "\x85", "\xa0", "\u200a", "\u200b", "\ufeff", "é", "😀"]
    rows = [(f"x{a}{b}{c}y",) for a in some for b in some for c in some]
    plain = [re.sub("[ \t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " ", r[0]) for r in rows]
    assert values(spark, rows, T.collapse(F.col("c0"))) == plain


def test_strip_html(spark):
    cases = {
        "<p>Hello <b>world</b></p>": "Hello world",
        "a&nbsp;b &amp; c": "a b & c",
        "&amp;lt;": "<",
        "it&#39;s": 'it"s',
        "caf&#233; &#8217; &#65601;": "café ’ A",
        "a  \n\t b": "a b",
        "": "",
        "&#99999999999999999999999999999999999999999999;": "�",
    }
    assert values(spark, [(k,) for k in cases], T.strip_html(F.col("c0"))) == list(cases.values())


def test_page_text(spark):
    html = "<style>p{}</style><SCRIPT type=x>var a='</p>'</SCRIPT><p>Hi &amp; bye</p>"
    assert values(spark, [(html,)], T.page_text(F.col("c0"))) == ["Hi & bye"]


@pytest.mark.parametrize(
    "text, low, high, currency, derived",
    [
        ("Pay $120k - $150k", 120000, 150000, "USD", False),
        ("€80,000", 80000, 80000, "EUR", False),
        ("$50/hr", 104000, 104000, "USD", True),
        ("£30 per hour", 62400, 62400, "GBP", True),
        ("$50-$60/hr", 50, 60, "USD", False),
        ("$120-150k", 120, 150000, "USD", False),
        ("$80k.", 80000, 80000, "USD", False),
        ("$,", 0, 0, "USD", False),
    ],
)
def test_parse_salary(spark, text, low, high, currency, derived):
    if text == "$,":
        # a lone comma is no number followed by a border
        assert values(spark, [(text,)], T.parse_salary(F.col("c0"))) == [None]
        return
    got = values(spark, [(text,)], T.parse_salary(F.col("c0")))[0]
    assert (got["min"], got["max"], got["currency"], got["derived"]) == (low, high, currency, derived)


def test_parse_salary_without_one(spark):
    assert values(spark, [("competitive pay",), ("",), (None,)], T.parse_salary(F.col("c0"))) == [None] * 3


def test_claims(spark):
    rows = [("Remote", "x"), (None, "hybrid work"), ("Paris", "on-site"), (None, "onsite"), ("Hybrid remote", ""), (None, "remotely"), (None, None)]
    assert values(spark, rows, T.remote_claim(F.col("c0"), F.col("c1"))) == ["remote", "hybrid", "onsite", "onsite", "remote", "unknown", "unknown"]
    rows = [("Full-time",), ("full time",), ("fulltime",), ("part time",), ("6-month contract",), ("contractor",), (None,)]
    assert values(spark, rows, T.employment_type(F.col("c0"))) == ["full-time"] * 3 + ["part-time", "contract", "unknown", "unknown"]


def test_fingerprint(spark):
    expected = hashlib.sha256(("dev|acme|" + "x" * 500).encode()).hexdigest()
    assert values(spark, [(" Dev ", "ACME ", "X" * 600)], T.fingerprint(F.col("c0"), F.col("c1"), F.col("c2"))) == [expected]
    assert values(spark, [("Dev", None, "")], T.fingerprint(F.col("c0"), F.col("c1"), F.col("c2"))) == [hashlib.sha256(b"dev||").hexdigest()]


def test_company_keys(spark):
    rows = [("Acme, Inc.",), ("ACME LLC",), ("Incubator Co",), (None,)]
    assert values(spark, rows, T.company_key(F.col("c0"))) == ["acme", "acme", "incubator", ""]
    assert values(spark, [("  Acme   Corp ",)], T.company_name_key(F.col("c0"))) == ["acme corp"]


def test_snippet(spark):
    text = "a" * 100 + " Needle " + "b" * 100
    got = values(spark, [(text, "needle")], T.snippet(F.col("c0"), F.col("c1")))[0]
    assert got.startswith("…") and got.endswith("…") and "Needle" in got and len(got) == 2 + 60 + 6 + 60
    assert values(spark, [("x" * 200, "needle")], T.snippet(F.col("c0"), F.col("c1"))) == ["x" * 160]


def test_redact_urls(spark):
    cases = {
        "see https://a.b/c?app_id=1&App_Key=2&q=3#token=4 and token=5": "see https://a.b/c?app_id=***&App_Key=***&q=3#token=4 and token=5",
        "https://a.b/c": "https://a.b/c",
        "(http://x.y/?token=a)(http://x.y/?mytoken=b)": "(http://x.y/?token=***)(http://x.y/?mytoken=b)",
        "none": "none",
    }
    assert values(spark, [(k,) for k in cases], T.redact_urls(F.col("c0"))) == list(cases.values())


def test_quebec_and_french(spark):
    rows = [("Montréal, QC",), ("Laval",), ("H2X 1Y4",), ("Toronto, ON",), (None,)]
    assert values(spark, rows, T.is_quebec(F.col("c0"))) == [True, True, True, False, False]
    assert values(spark, [("Nous cherchons une équipe pour le poste",)], T.french_signals(F.col("c0"))) == [6]


def test_hosts(spark):
    rows = [("https://www.acme.com/about",), ("https://blog.acme.co:80/",), ("http://u@localhost/x",), ("nothing",)]
    assert values(spark, rows, web.host_label(F.col("c0"))) == ["acme", "acme", "localhost", ""]
    labels = values(spark, [("VDart Inc",), ("Mirakl Labs",)], web.own_site_labels(F.col("c0")))
    assert [sorted(x) for x in labels] == [["vdart", "vdartinc"], ["mirakl", "mirakllabs"]]


def test_page_identity(spark):
    about = web.page_is_about(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3"))
    rows = [
        ("Busbud", "Busbud reviews", "https://x.com", ""),
        ("Bus.com", "Busbud reviews", "https://x.com", "nothing"),
        ("Acme Rockets Inc", "about us", "https://x.com/rockets", ""),
        ("Big Blue Machines", "BBM at a glance", "https://x.com", ""),
        ("Acme", "other", "https://x.com", "we work at acme daily"),
        ("", "any", "any", "any"),
    ]
    assert values(spark, rows, about) == [True, False, True, True, True, False]
