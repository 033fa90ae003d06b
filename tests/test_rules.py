from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestack.functions import replies
from lodestack.functions import vocabulary as V
from lodestack.functions.phrases import with_hits
from lodestack.operators import rules
from lodestack.operators.rules import Rule
from lodestack.plans.queries import QUERIES

SCHEMA = "posting_id bigint, title string, company_name string, location_raw string, salary_min double, salary_max double, salary_currency string, remote_claim string, employment_type string, description_clean string"


def posting(**changes):
    base = dict(posting_id=1, title="Engineer", company_name="Acme", location_raw="Remote (Canada)", salary_min=120000.0, salary_max=150000.0, salary_currency="USD", remote_claim="remote", employment_type="full-time", description_clean="We use Python. Fluent in French required.")
    return tuple({**base, **changes}.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize(
    "field, operator, value, expected",
    [
        ("salary_min", ">=", 100000, True), ("salary_min", ">", "120000", False), ("salary_min", "==", 120000, True), ("salary_min", "==", "120000", False),
        ("salary_min", "!=", "120000", True), ("salary_min", ">=", None, True), ("title", "contains", "ENG", True), ("title", "in", ["Engineer"], True),
        ("salary_min", "in", ["120000"], False), ("title", ">", 1, False), ("salary_min", "contains", "120000", True), ("title", "!=", None, True),
    ],
)
def test_field_rules(spark, field, operator, value, expected):
    assert frame(spark, posting()).select(rules.field_holds(field, operator, value)).first()[0] is expected


def test_missing_values_equal_only_null(spark):
    rows = frame(spark, posting(salary_min=None))
    got = rows.select(*[rules.field_holds("salary_min", o, v).alias(f"c{i}") for i, (o, v) in enumerate([("==", None), ("!=", None), ("!=", 5), (">=", 0), ("contains", "null")])]).first()
    assert list(got) == [True, False, False, False, False]


def test_cascade_stops_at_the_first_knock_out(spark):
    chosen = [
        Rule("semantic", "preferred", "semantic", {"statement": "s", "vector": [1.0, 0.0]}, 1),
        Rule("remote", "required", "keyword", {"field": "remote_claim", "operator": "==", "value": "remote"}, 2),
        Rule("no python", "dealbreaker", "keyword", {"patterns": ["python"]}, 3),
    ]
    rows = frame(spark, posting(), posting(posting_id=2, description_clean="Java"), posting(posting_id=3, remote_claim="onsite"), posting(posting_id=4, description_clean="Java"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.4, 0.6])], "posting_id bigint, vec array<double>")
    got = {r["posting_id"]: (r["outcome"], [x["rule_id"] for x in r["results"]], [x["verdict"] for x in r["results"]]) for r in rules.evaluate(rows, chosen, vectors=vectors).collect()}
    assert got == {
        1: ("knocked_out", [2, 3], ["pass", "pass"]),
        2: ("passed", [2, 3, 1], ["pass", "fail", "fail"]),
        3: ("knocked_out", [2], ["fail"]),
        4: ("needs_review", [2, 3, 1], ["pass", "fail", "uncertain"]),
    }


class Counting:
    def __init__(self, path):
        self.path = path

    def complete(self, prompt, max_tokens):
        with open(self.path, "a") as f:
            f.write("x")
        return 'sure: {"verdict": "Pass", "evidence": "yes"}'


def test_judge_sees_only_what_is_left(spark, tmp_path):
    chosen = [Rule("remote", "required", "keyword", {"field": "remote_claim", "operator": "==", "value": "remote"}, 1), Rule("good", "dealbreaker", "llm_judge", {"question": "bad?"}, 2), Rule("never", "required", "llm_judge", {"question": "?"}, 3)]
    rows = frame(spark, *[posting(posting_id=i, remote_claim="remote" if i < 3 else "onsite") for i in range(10)])
    done = rules.evaluate(rows, chosen, judge=Counting(str(tmp_path / "calls"))).collect()
    assert {r["posting_id"]: (r["outcome"], len(r["results"])) for r in done} == {i: ("knocked_out", 2 if i < 3 else 1) for i in range(10)}
    assert len((tmp_path / "calls").read_text()) == 3


def test_read_verdict():
    assert replies.verdict('{"verdict":"fail","evidence":" no "}') == ("fail", "no")
    assert replies.verdict("maybe") == ("uncertain", "maybe")
    assert replies.verdict('{"verdict":"maybe"}') == ("uncertain", '{"verdict":"maybe"}')
    assert replies.verdict("") == ("uncertain", None)


def test_languages(spark):
    cases = {
        "Must speak German.": ["de"],
        "Bilingual English/French.": ["en", "fr"],
        "Maîtrise du français exigée": ["fr"],
        "We love French food": [],
        "Fluent in Spanish and English": ["es", "en"],
        "": [],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").orderBy("i")
    got = [[x["code"] for x in r["r"]] for r in with_hits(rows, F.col("t"), {"named": rules.LANGUAGE_NAMES}).select("i", rules.required_languages(F.col("t"), F.col("named")).alias("r")).orderBy("i").collect()]
    assert [sorted(g) for g in got] == [sorted(c) for c in cases.values()]


def test_languages_are_looked_for_once(spark):
    """Each language's patterns stand once in the plan, for codes, filter and verdict together."""
    found = QUERIES["q09_language_rule"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("fluency in") == len(V.LANGUAGES)


def test_language_rule_untold(spark):
    rows = spark.createDataFrame([(1, "Fluent in German and English", ""), (2, "English required", "Plain"), (3, "German", None)], "i int, title string, description_clean string")
    named = with_hits(rows, rules.posting_text(), {"named": rules.LANGUAGE_NAMES}).withColumn("r", rules.required_languages(rules.posting_text(), F.col("named")))
    told = rules.language_rule(["en"], F.col("named"))
    bare = rules.language_rule(["en"], F.col("named"), found=F.col("r"), told=False)
    got = named.select(told.alias("told"), bare.alias("bare")).orderBy("i").collect()
    assert [(r["told"] and r["told"]["verdict"]) for r in got] == [(r["bare"] and r["bare"]["verdict"]) for r in got] == ["fail", "pass", None]
    assert got[0]["told"]["evidence"] and got[0]["bare"]["evidence"] is None


def test_language_rule_comes_first(spark):
    rows = frame(spark, posting(), posting(posting_id=2, description_clean="plain"))
    done = {r["posting_id"]: r for r in rules.evaluate(rows, [], spoken=["en"]).collect()}
    assert done[1]["outcome"] == "knocked_out" and "French" in done[1]["results"][0]["evidence"]
    assert done[2]["outcome"] == "passed" and done[2]["results"] == []


@pytest.mark.parametrize("bad", [Rule("", "required", "keyword", {"patterns": ["a"]}), Rule("a", "x", "keyword", {"patterns": ["a"]}), Rule("a", "required", "keyword", {"patterns": []}), Rule("a", "required", "semantic", {}), Rule("a", "required", "llm_judge", {"question": " "}), Rule("a", "required", "semantic", {"statement": "s", "threshold": 2})])
def test_malformed_rules(bad):
    with pytest.raises(ValueError):
        bad.checked()


def test_templates():
    assert len(rules.TEMPLATES) == 10
    with pytest.raises(ValueError):
        rules.from_template("location-mentions")
    assert rules.from_template("location-mentions", config={"value": "Paris"}).config["value"] == "Paris"


def test_phrases_in_one_pass(spark):
    lists = {"a": ["go", "Golang", "c++", "go"], "b": ["lang", "golang is", "é"], "none": []}
    texts = ["GOLANG IS fine", "lan g", None, "", "É c+ c++", "gogogo"]
    rows = with_hits(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), F.col("t"), lists).orderBy("i").collect()
    for row, text in zip(rows, texts):
        low = (text or "").lower()
        assert {n: row[n] for n in lists} == {n: [p for p in phrases if p.lower() in low] for n, phrases in lists.items()}
