"""User rules over postings, compiled to columns and evaluated as a cost-ordered cascade."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import replies
from lodestack.functions import vocabulary as V
from lodestack.functions.phrases import with_hits
from lodestack.functions.text import bound, cosine, number_text, snippet
from lodestack.plugins import Judge
from lodestack.schemas import RULE_RESULT
from lodestack.storage import settled

KINDS = ("required", "preferred", "dealbreaker")
OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "contains", "in")
NUMBER_FIELDS = ("salary_min", "salary_max")
FIELDS = (*NUMBER_FIELDS, "remote_claim", "employment_type", "location_raw", "company_name", "title")
TARGETS = {"title": "title", "location": "location_raw", "description": "description_clean"}


@dataclass(frozen=True)
class Rule:
    """One rule. ``config`` has patterns (target, match), or field, operator and value, or statement
    (vector, threshold), or question."""

    name: str
    kind: str
    validator: str
    config: dict[str, Any] = field(default_factory=dict)
    rule_id: int = 0
    active: bool = True

    def checked(self) -> Rule:
        """Itself; ValueError for a malformed rule."""
        c = self.config
        if not isinstance(self.name, str) or not self.name.strip():
            raise ValueError("a rule needs a name")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if self.validator not in V.VALIDATOR_COST:
            raise ValueError(f"validator must be one of {', '.join(V.VALIDATOR_COST)}")
        if not isinstance(c, dict):
            raise ValueError("config must be a dict")
        if self.validator == "keyword":
            if isinstance(c.get("patterns"), list):
                if not c["patterns"]:
                    raise ValueError("patterns must not be empty")
                if c.get("match") not in (None, "any", "all"):
                    raise ValueError("match must be 'any' or 'all'")
            elif c.get("field") not in FIELDS or c.get("operator") not in OPERATORS:
                raise ValueError("a keyword rule needs patterns, or field, operator and value")
        if self.validator == "semantic":
            if not isinstance(c.get("statement"), str) or not c["statement"].strip():
                raise ValueError("a semantic rule needs a statement")
            threshold = c.get("threshold")
            if threshold is not None and not 0 <= float(threshold) <= 1:
                raise ValueError("threshold must be between 0 and 1")
        if self.validator == "llm_judge" and (not isinstance(c.get("question"), str) or not c["question"].strip()):
            raise ValueError("a judge rule needs a question")
        return self

    def needs_model(self) -> bool:
        """Whether evaluating it calls a model."""
        return self.validator == "llm_judge" or self.validator == "semantic" and not isinstance(self.config.get("vector"), list)


def by_cost(rules: Sequence[Rule]) -> list[Rule]:
    """Cheapest validators first, else in the given order."""
    return sorted((r for r in rules if r.active), key=lambda r: V.VALIDATOR_COST[r.validator])


def _number(value: Any) -> float | None:
    """A constant as a number the way loosely typed comparison takes it; None if it is none."""
    if value is None or value is False or value == "" or value == []:
        return 0.0
    if isinstance(value, list):
        return _number(value[0]) if len(value) == 1 else None
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if abs(number) != float("inf") and number == number else None


def _shown(value: Any) -> str:
    """A constant as text."""
    if value is None:
        return "null"
    if isinstance(value, list):
        return ",".join(_shown(v) for v in value)
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def field_holds(name: str, operator: str, value: Any) -> Column:
    """A field comparison; never null. A missing value only equals null; text never equals a number."""
    column, numeric = F.col(name), name in NUMBER_FIELDS
    same_type = lambda v: _is_number(v) if numeric else isinstance(v, str)
    as_number = column if numeric else F.when(F.trim(column) == "", F.lit(0.0)).otherwise(F.trim(column).try_cast("double"))
    if operator == "==":
        held = column.isNull() if value is None else (column == F.lit(value) if same_type(value) else F.lit(False))
    elif operator == "!=":
        held = column != F.lit(value) if same_type(value) else column.isNotNull()
    elif operator == "contains":
        text = number_text(column) if numeric else column
        held = F.contains(F.lower(text), F.lit(_shown(value).lower()))
    elif operator == "in":
        kept = [v for v in value if same_type(v)] if isinstance(value, list) else []
        held = column.isin(kept) if kept else F.lit(False)
    else:
        other = _number(value)
        compare = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}[operator]
        held = F.lit(False) if other is None else compare(as_number, F.lit(other)) & ~F.isnan(as_number)
    return F.coalesce(held, F.lit(False))


def pattern_match(config: dict[str, Any], hits: Column) -> tuple[Column, Column]:
    """Whether any (or all) patterns occur in the target text, and the first one's surroundings if so; ``hits`` are those that occur."""
    text = F.coalesce(F.col(TARGETS[config.get("target") or "description"]), F.lit(""))
    held = F.size(hits) == len(config["patterns"]) if config.get("match") == "all" else F.size(hits) > 0
    return held, F.when(held, snippet(text, F.get(hits, F.lit(0))))


def searched(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` with a column for each rule of patterns (see :func:`hits_of`), one pass over each target text for all rules."""
    by_target: dict[str, dict[str, list[str]]] = {}
    for i, rule in enumerate(rules):
        if rule.validator == "keyword" and "patterns" in rule.config:
            by_target.setdefault(TARGETS[rule.config.get("target") or "description"], {})[hits_of(i)] = rule.config["patterns"]
    for target, lists in by_target.items():
        rows = with_hits(rows, F.col(target), lists)
    return rows


def hits_of(place: int) -> str:
    """The column with the patterns found of the rule at this place."""
    return f"__patterns{place}"


def _result(rule: Rule, verdict: Column, evidence: Column) -> Column:
    parts = {"rule_id": F.lit(rule.rule_id), "rule_name": F.lit(rule.name), "kind": F.lit(rule.kind), "validator": F.lit(rule.validator), "verdict": verdict, "evidence": evidence}
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(RULE_RESULT)


def compile_rule(rule: Rule, vector: list[float] | None = None, place: int = 0) -> Column:
    """A keyword or semantic rule as a result struct; semantic ones read the column ``vec``, patterns that of :func:`hits_of`.

    A posting without a vector is uncertain.
    """
    c = rule.checked().config
    if rule.validator == "keyword" and "patterns" in c:
        held, evidence = pattern_match(c, F.col(hits_of(place)))
        return _result(rule, F.when(held, "pass").otherwise("fail"), evidence)
    if rule.validator == "keyword":
        shown = F.coalesce(number_text(F.col(c["field"])) if c["field"] in NUMBER_FIELDS else F.col(c["field"]), F.lit("(none)"))
        return _result(rule, F.when(field_holds(c["field"], c["operator"], c.get("value")), "pass").otherwise("fail"), F.concat(F.lit(f"{c['field']} = "), shown))
    threshold = V.SEMANTIC_DEFAULT if c.get("threshold") is None else float(c["threshold"])
    similar = cosine(F.col("vec"), F.lit(list(map(float, c.get("vector") or vector or []))))
    verdict = F.when(similar.isNull(), "uncertain").when(similar >= threshold, "pass").otherwise("fail")
    evidence = F.when(similar.isNotNull(), F.format_string(f"similarity %.3f, {threshold:g} wanted", similar)).otherwise("the posting has no vector")
    return _result(rule, verdict, evidence)


def _language_pattern(phrase: str, names: list[str]) -> str:
    longest = sorted(names, key=lambda n: -len(n))
    body = phrase.replace("{name}", "(?:" + "|".join(map(re.escape, longest)) + ")")
    return rf"(?<![\p{{L}}\p{{M}}])(?:{body})(?![\p{{L}}\p{{M}}])"


#: All names of languages.
LANGUAGE_NAMES = [n for _, _, forms in V.LANGUAGES for n in forms]


def posting_text() -> Column:
    """What the language rule reads."""
    return F.concat_ws("\n", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("description_clean"), F.lit("")))


def required_languages(text: Column, named: Column) -> Column:
    """array<struct(code, phrase)>: each language the text requires, with the first phrase that says so.

    Phrases for one language come first, in language order, then phrases for two.
    ``named``: which of ``LANGUAGE_NAMES`` occur; only these languages' phrases are
    looked for.
    """
    names = LANGUAGE_NAMES
    both_columns = F.struct(F.lower(text).alias("t"), named.alias("named"))  # only where a language is named

    def named_as(code: str) -> Callable[[Column], Column]:
        return lambda x: F.when(x.isNotNull(), F.struct(F.lit(code).alias("code"), x.alias("phrase")))

    def singles(t: Column, held: Column) -> list[Column]:
        made = []
        for code, _, forms in V.LANGUAGES:
            # not nullif, which runs its search twice within a lambda
            tries = [bound(F.regexp_extract(t, _language_pattern(p, forms), 0), lambda x: F.when(x != "", x)) for p in V.LANGUAGE_PHRASES]
            phrase = F.when(F.arrays_overlap(held, F.array(*map(F.lit, forms))), F.coalesce(*tries))
            made.append(bound(phrase, named_as(code)))
        return made

    code_of = F.create_map(*[F.lit(x) for code, _, forms in V.LANGUAGES for n in forms for x in (n, code)])

    def pairs(t: Column, pattern: str) -> Column:
        body = _language_pattern(pattern, names)
        found = [F.regexp_extract_all(t, F.lit(body), F.lit(g)) for g in (0, 1, 2)]
        both = F.arrays_zip(*[f.alias(f"g{g}") for g, f in enumerate(found)])
        return F.flatten(F.transform(both, lambda m: F.array(*[F.struct(F.element_at(code_of, m[f"g{g}"]).alias("code"), m["g0"].alias("phrase")) for g in (1, 2)])))

    def first_of_each(all_found: Column) -> Column:
        earlier = lambda x, i: F.exists(F.slice(all_found, F.lit(1), i), lambda y: y.code == x.code)
        return F.filter(all_found, lambda x, i: ~F.when(i > 0, earlier(x, i)).otherwise(F.lit(False)))

    none = F.array().cast("array<struct<code:string,phrase:string>>")

    def scan(t: Column, held: Column) -> Column:
        of_two = F.when(F.size(held) > 1, F.concat(*[pairs(t, p) for p in V.LANGUAGE_PAIR_PHRASES])).otherwise(none)
        return bound(F.concat(F.array_compact(F.array(*singles(t, held))), of_two), first_of_each)

    return F.when(F.size(named) > 0, bound(both_columns, lambda c: scan(c.t, c.named))).otherwise(none)


def language_rule(spoken: Sequence[str], named: Column, found: Column | None = None, told: bool = True) -> Column:
    """The built-in rule's result: fails if a required language isn't spoken; null if none is required. ``named``: see :func:`required_languages`.

    ``found`` is what that function gave, where it is a column already; without
    ``told`` there is no evidence.
    """
    display = {code: name for code, name, _ in V.LANGUAGES}
    names = F.create_map(*[F.lit(x) for pair in display.items() for x in pair])
    text = posting_text()
    codes = [s.lower() for s in spoken]
    listed = ", ".join(display.get(s, s) for s in spoken)
    joined = lambda found: F.array_join(F.transform(found, lambda x: F.element_at(names, x.code)), " and ")
    rule = Rule("Languages asked for", "required", "keyword")

    def judged(found: Column) -> Column:
        missing = F.filter(found, lambda x: ~x.code.isin(codes) if codes else F.lit(True))

        def result(gone: Column) -> Column:
            if not told:
                return _result(rule, F.when(F.size(gone) == 0, "pass").otherwise("fail"), F.lit(None))
            good = F.concat(F.lit("Asks for "), joined(found), F.lit(f", which you speak ({listed})."))
            bad = F.concat(F.lit("Asks for "), joined(gone), F.lit(f", which you do not speak ({listed}). It says: "), snippet(text, F.get(gone, F.lit(0)).phrase))
            return F.when(F.size(gone) == 0, _result(rule, F.lit("pass"), good)).otherwise(_result(rule, F.lit("fail"), bad))

        return F.when(F.size(found) > 0, bound(missing, result))

    return bound(required_languages(text, named) if found is None else found, judged)


def knocks_out(result: Column) -> Column:
    return ((result.kind == "required") & (result.verdict == "fail")) | ((result.kind == "dealbreaker") & (result.verdict == "pass"))


def concluded(results: Column) -> Column:
    """struct(outcome, results): results end with the first one that knocks out."""

    def close(r: Column) -> Column:
        at = F.array_position(F.transform(r, lambda x: knocks_out(x)), F.lit(True)).cast("int")
        unsure = F.exists(r, lambda x: x.verdict == "uncertain")
        outcome = F.when(at > 0, "knocked_out").when(unsure, "needs_review").otherwise("passed")
        return F.struct(outcome.alias("outcome"), F.when(at > 0, F.slice(r, F.lit(1), at)).otherwise(r).alias("results"))

    return bound(F.array_compact(results), close)


def judge_prompt(question: str) -> Column:
    """What a judge is asked about a posting."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    pay = F.when(F.col("salary_min").isNull(), "not disclosed").otherwise(
        F.concat_ws(" ", F.concat(number_text(F.col("salary_min")), F.lit("–"), F.coalesce(number_text(F.col("salary_max")), F.lit("?"))), F.col("salary_currency"))
    )
    lines = [
        F.lit(f"Decide whether this job posting meets the criterion: {question}"),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Company: "), known("company_name")),
        F.concat(F.lit("Location: "), known("location_raw")),
        F.concat(F.lit("Work mode claimed: "), known("remote_claim")),
        F.concat(F.lit("Employment type: "), known("employment_type")),
        F.concat(F.lit("Pay: "), pay),
        F.concat(F.lit("Description: "), F.coalesce("description_clean", F.lit("(none)"))),
        F.lit('Answer with one JSON object: {"verdict": "pass" or "fail" or "uncertain", "evidence": "short quote or reason"}'),
    ]
    return F.concat_ws("\n", *lines)


def _judging(rules: list[Rule], judge: Judge) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for posting_id, prompts in zip(frame["posting_id"], frame["prompts"]):
                told = []
                for rule, prompt in zip(rules, prompts):
                    verdict, evidence = replies.verdict(judge.complete(prompt, int(rule.config.get("maxTokens") or 512)))
                    told.append({"rule_id": rule.rule_id, "rule_name": rule.name, "kind": rule.kind, "validator": rule.validator, "verdict": verdict, "evidence": evidence})
                    if (rule.kind, verdict) in (("required", "fail"), ("dealbreaker", "pass")):
                        break
                rows.append((posting_id, told))
            yield pd.DataFrame(rows, columns=["posting_id", "judged"])

    return run


def evaluate(
    postings: DataFrame,
    rules: Sequence[Rule],
    spoken: Sequence[str] = (),
    vectors: DataFrame | None = None,
    statement_vectors: dict[str, list[float]] | None = None,
    judge: Judge | None = None,
) -> DataFrame:
    """posting_id, outcome, results of the cascade.

    Keyword and semantic rules are columns of one projection. Only postings that
    they don't knock out go to the judge, in a plan of their own, as a model
    inside a conditional would still run for all rows.
    """
    ordered = by_cost([r.checked() for r in rules])
    cheap = [r for r in ordered if r.validator != "llm_judge"]
    dear = [r for r in ordered if r.validator == "llm_judge"]
    rows = postings
    if any(r.validator == "semantic" for r in cheap):
        held = vectors.select("posting_id", "vec") if vectors is not None else postings.select("posting_id", F.lit(None).cast("array<double>").alias("vec")).limit(0)
        rows = postings.drop("vec").join(held, "posting_id", "left")
    given = statement_vectors or {}
    rows = searched(rows, cheap)
    results = [compile_rule(r, given.get(r.config.get("statement", "")), i) for i, r in enumerate(cheap)]
    if spoken:
        rows = with_hits(rows, posting_text(), {"__languages": LANGUAGE_NAMES})
        results.insert(0, language_rule(spoken, F.col("__languages")))
    every = F.array(*results).cast(f"array<{RULE_RESULT}>") if results else F.array().cast(f"array<{RULE_RESULT}>")
    prompts = F.array(*[judge_prompt(r.config["question"]) for r in dear]) if dear else F.array().cast("array<string>")
    staged = rows.select("posting_id", concluded(every).alias("c"), prompts.alias("prompts")).select("posting_id", "c.outcome", "c.results", "prompts")
    if not dear:
        return staged.drop("prompts")
    if judge is None:
        raise ValueError("rules of kind llm_judge need a judge")
    staged = settled(staged)  # the judge is asked once
    asked = staged.where("outcome <> 'knocked_out'").select("posting_id", "prompts").mapInPandas(_judging(dear, judge), f"posting_id bigint, judged array<{RULE_RESULT}>")
    done = staged.join(asked, "posting_id", "left")
    return done.select("posting_id", concluded(F.concat("results", F.coalesce("judged", F.array().cast(f"array<{RULE_RESULT}>")))).alias("c")).select("posting_id", "c.outcome", "c.results")


def outcome_counts(evaluations: DataFrame) -> DataFrame:
    """One row: how many passed, were knocked out, and need review."""
    return evaluations.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "knocked_out", "needs_review")])


_field = lambda name, operator, value: {"field": name, "operator": operator, "value": value}
#: Premade rules by id: group, and the rule. ``location-mentions`` needs a value of its own.
TEMPLATES: dict[str, tuple[str, Rule]] = {
    "remote-only": ("work mode", Rule("Remote only", "required", "keyword", _field("remote_claim", "==", "remote"))),
    "hybrid-or-remote": ("work mode", Rule("Hybrid or remote", "required", "keyword", _field("remote_claim", "in", ["remote", "hybrid"]))),
    "no-onsite": ("work mode", Rule("No onsite", "dealbreaker", "keyword", _field("remote_claim", "==", "onsite"))),
    "salary-floor-100k": ("salary", Rule("Salary floor $100k", "required", "keyword", _field("salary_min", ">=", 100000))),
    "salary-disclosed": ("salary", Rule("Salary disclosed", "required", "keyword", _field("salary_min", "!=", None))),
    "location-mentions": ("location", Rule("Location mentions…", "preferred", "keyword", _field("location_raw", "contains", ""))),
    "domain-backend": ("domain", Rule("Backend development", "preferred", "semantic", {"statement": "Software work on servers, interfaces, databases and infrastructure.", "threshold": 0.5})),
    "domain-data-ai": ("domain", Rule("Data / AI / ML", "preferred", "semantic", {"statement": "Work on data pipelines, artificial intelligence or machine learning.", "threshold": 0.5})),
    "employment-full-time": ("employment type", Rule("Full-time", "preferred", "keyword", _field("employment_type", "==", "full-time"))),
    "no-part-time": ("employment type", Rule("No part-time", "dealbreaker", "keyword", _field("employment_type", "==", "part-time"))),
}


def from_template(template_id: str, name: str | None = None, kind: str | None = None, config: dict[str, Any] | None = None, rule_id: int = 0) -> Rule:
    """A premade rule with some parts replaced."""
    if template_id not in TEMPLATES:
        raise ValueError(f"unknown template {template_id}")
    rule = TEMPLATES[template_id][1]
    merged = {**rule.config, **(config or {})}
    if template_id == "location-mentions" and not str(merged.get("value") or "").strip():
        raise ValueError("this template needs a place")
    return replace(rule, name=name or rule.name, kind=kind or rule.kind, config=merged, rule_id=rule_id)
