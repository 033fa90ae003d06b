"""Small stored things: rules, configuration, switches, profiles, remembered answers, credentials.

Each is a table of few rows in the store, read to the driver by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import asdict, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestack.functions import vocabulary as V
from lodestack.operators.ingest import with_ids
from lodestack.operators.rules import Rule
from lodestack.operators.scoring import Profile
from lodestack.plugins import Embedder
from lodestack.sources.landing import SOURCES, IngestConfig, resolve
from lodestack.sources.store import TableStore
from lodestack.storage import ready, settled

RULE = "rule_id bigint, name string, kind string, validator string, config string, active boolean, created_at_ms bigint"
SETTING = "scope string, name string, value string, updated_at_ms bigint"


def rule_of(row: Any) -> Rule:
    """A stored rule as an object."""
    return Rule(row["name"], row["kind"], row["validator"], json.loads(row["config"]), row["rule_id"], bool(row["active"]))


def with_errors(rows: DataFrame) -> DataFrame:
    """``rows`` (name, kind, validator, config as JSON) with ``error``: null for a valid rule, or what is wrong with it."""

    def told(name: Any, kind: Any, validator: Any, config: Any) -> str | None:
        try:
            Rule(name, kind, validator, json.loads(config) if config is not None else None).checked()
        except (ValueError, TypeError) as error:
            return "config is not JSON" if isinstance(error, json.JSONDecodeError) else str(error)
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = frame[["name", "kind", "validator", "config"]].astype(object).where(lambda f: f.notna(), None)
            yield frame.assign(error=[told(*row) for row in parts.itertuples(index=False, name=None)])

    ready(rows.sparkSession)
    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("error", StringType())]))


class Rulebook:
    """Users' rules in the table ``rules``."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def rows(self) -> DataFrame:
        return self.store.read_or_empty("rules", RULE)

    def _put(self, rule: Rule, created_at_ms: int) -> Rule:
        rule = rule.checked()
        row = (rule.rule_id, rule.name, rule.kind, rule.validator, json.dumps(rule.config, sort_keys=True), rule.active, created_at_ms)
        self.store.upsert("rules", self.store.spark.createDataFrame([row], RULE), ["rule_id"])
        return rule

    def insert(self, rule: Rule, now_ms: int) -> Rule:
        """Store a new rule under the next id."""
        last = self.rows().agg(F.max("rule_id")).first()[0] or 0
        return self._put(replace(rule, rule_id=last + 1), now_ms)

    def insert_rows(self, rows: DataFrame, order: list[str], now_ms: int) -> DataFrame:
        """Store the valid ones of many new rules (columns of RULE but for rule_id and created_at_ms) under the next ids, in ``order``.

        Returns all ``rows`` with ``error``: null, or why a rule was refused.
        """
        judged = settled(with_errors(rows))
        change = self.store.change()
        last = change.read_or_empty("rules", RULE).agg(F.max("rule_id")).first()[0] or 0
        made = with_ids(judged.where("error is null"), last, order).withColumnRenamed("posting_id", "rule_id").withColumn("created_at_ms", F.lit(now_ms).cast("bigint"))
        change.upsert("rules", made.select([c.split()[0] for c in RULE.split(", ")]), ["rule_id"]).commit()
        return judged

    def get(self, rule_id: int) -> Rule | None:
        row = self.rows().where(F.col("rule_id") == rule_id).first()
        return None if row is None else rule_of(row)

    def update(self, rule_id: int, **changes: Any) -> Rule | None:
        """Change name, kind, config or active of a rule; None if there is no such rule."""
        if extra := set(changes) - {"name", "kind", "config", "active"}:
            raise ValueError(f"a rule's {', '.join(sorted(extra))} can't be changed")
        row = self.rows().where(F.col("rule_id") == rule_id).first()
        if row is None:
            return None
        rule = replace(rule_of(row), **changes)
        if rule.config.get("model") and rule.config.get("statement") != json.loads(row["config"]).get("statement"):
            # another statement needs another vector
            rule = replace(rule, config={k: v for k, v in rule.config.items() if k not in ("vector", "model")})
        return self._put(rule, row["created_at_ms"])

    def with_vectors(self, embedder: Embedder) -> int:
        """Embed the statements of semantic rules that have no vector of the model yet, and keep them in the rules; how many.

        Rules are few; all statements are embedded at once.
        """
        wanted = [r for r in self.rows().where("validator = 'semantic'").collect() if json.loads(r["config"]).get("model") != embedder.model]
        if not wanted:
            return 0
        texts = self.store.spark.createDataFrame([(r["rule_id"], json.loads(r["config"])["statement"]) for r in wanted], "rule_id bigint, text string")
        vectors = {r["rule_id"]: [float(x) for x in r["vec"]] for r in embedder.embed(texts).collect()}
        rows = [{**r.asDict(), "config": json.dumps({**json.loads(r["config"]), "vector": vectors[r["rule_id"]], "model": embedder.model}, sort_keys=True)} for r in wanted]
        self.store.upsert("rules", self.store.spark.createDataFrame([tuple(r[c.split()[0]] for c in RULE.split(", ")) for r in rows], RULE), ["rule_id"])
        return len(rows)

    def delete(self, rule_id: int) -> bool:
        """Whether there was such a rule."""
        return self.store.exists("rules") and self.store.delete("rules", F.col("rule_id") == rule_id) > 0

    def listed(self) -> DataFrame:
        """All rules, newest first."""
        return self.rows().orderBy(F.desc("created_at_ms"), F.desc("rule_id"))

    def active(self) -> list[Rule]:
        """The rules that are on, in the order of their ids."""
        return [rule_of(r) for r in self.rows().where("active").orderBy("rule_id").collect()]


class Settings:
    """JSON values by scope and name in the table ``settings``."""

    def __init__(self, store: TableStore) -> None:
        self.store = store

    def get(self, scope: str, name: str) -> Any:
        """A stored value, or None."""
        row = self.store.read_or_empty("settings", SETTING).where((F.col("scope") == scope) & (F.col("name") == name)).first()
        return None if row is None else json.loads(row["value"])

    def all(self, scope: str) -> dict[str, Any]:
        rows = self.store.read_or_empty("settings", SETTING).where(F.col("scope") == scope).collect()
        return {r["name"]: json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["name"])}

    def put(self, scope: str, name: str, value: Any, now_ms: int) -> Any:
        row = self.store.spark.createDataFrame([(scope, name, json.dumps(value, sort_keys=True), now_ms)], SETTING)
        self.store.upsert("settings", row, ["scope", "name"])
        return value

    def put_rows(self, rows: DataFrame) -> None:
        """Store many values at once (columns of SETTING, value as JSON)."""
        self.store.upsert("settings", rows.select([c.split()[0] for c in SETTING.split(", ")]), ["scope", "name"])

    def forget(self, scope: str, name: str) -> bool:
        """Whether there was such a value."""
        return self.store.exists("settings") and self.store.delete("settings", (F.col("scope") == scope) & (F.col("name") == name)) > 0

    def profile(self) -> Profile:
        """The user's stored profile, or an empty one."""
        value = self.get("profile", "user") or {}
        vector = value.get("vector")
        return Profile(value.get("skills_text"), value.get("years"), tuple(vector) if vector else None)

    def save_profile(self, profile: Profile, now_ms: int) -> Profile:
        self.put("profile", "user", asdict(profile), now_ms)
        return profile

    def flags(self) -> dict[str, bool]:
        """Every flag type and whether it is on; one without a setting is."""
        stored = self.all("flag")
        return {t: bool(stored.get(t, True)) for t in V.FLAG_TYPES}

    def set_flag(self, flag_type: str, enabled: bool, now_ms: int) -> None:
        if flag_type not in V.FLAG_TYPES:
            raise ValueError(f"unknown flag type {flag_type}")
        self.put("flag", flag_type, bool(enabled), now_ms)

    def credentials(self) -> dict[str, dict[str, str]]:
        """Stored secrets by source and field."""
        made: dict[str, dict[str, str]] = {}
        for name, value in self.all("credential").items():
            source, field = name.split("/", 1)
            made.setdefault(source, {})[field] = value
        return made

    def save_credential(self, source: str, field: str, value: str, now_ms: int) -> None:
        if source not in SOURCES or field not in SOURCES[source].credentials:
            raise ValueError(f"{source} has no credential {field}")
        self.put("credential", f"{source}/{field}", value, now_ms)

    def delete_credential(self, source: str, field: str) -> bool:
        return self.forget("credential", f"{source}/{field}")

    def ingest_config(self, environment: Mapping[str, str], now_ms: int) -> IngestConfig:
        """The stored configuration; on first reading the environment's defaults are stored."""
        value = self.get("ingest", "config")
        if value is None:
            value = asdict(replace(resolve(defaults_of(environment)), credentials={}))
            self.put("ingest", "config", value, now_ms)
        return viewed(IngestConfig(**{**value, "enabled": tuple(value["enabled"]) if value["enabled"] is not None else None}))

    def save_ingest_config(self, config: IngestConfig, now_ms: int) -> IngestConfig:
        """Store it with texts trimmed, empty ones unset and the country in lower case."""
        clean = lambda x: (x or "").strip() or None
        kept = replace(config, **{n: clean(getattr(config, n)) for n in ("query", "city", "province", "category")}, country=(clean(config.country) or "").lower() or None, credentials={})
        self.put("ingest", "config", asdict(kept), now_ms)
        return viewed(kept)


def viewed(config: IngestConfig) -> IngestConfig:
    """Without sources that the registry doesn't know (any more)."""
    return config if config.enabled is None else replace(config, enabled=tuple(s for s in config.enabled if s in SOURCES))


def defaults_of(environment: Mapping[str, str]) -> IngestConfig:
    """The environment's layer: texts, credentials of one board, and the sources that work with them."""
    text = lambda name: environment.get(name, "").strip() or None
    secrets = {field: value for field, name in (("app_id", "ADZUNA_APP_ID"), ("app_key", "ADZUNA_APP_KEY")) if (value := text(name))}
    enabled = (*V.DEFAULT_SOURCES, *(["adzuna"] if len(secrets) == 2 else []))
    return IngestConfig(enabled, text("ADZUNA_WHAT"), text("ADZUNA_WHERE"), None, (text("ADZUNA_COUNTRY") or "us").lower(), None, {"adzuna": secrets} if secrets else {})


def pages_of(environment: Mapping[str, str]) -> int:
    """How many pages of the paginated board are read."""
    try:
        return max(0, int(float(environment.get("ADZUNA_MAX_PAGES", "").strip())))
    except (ValueError, OverflowError):
        return V.ADZUNA_PAGES


#: Stands for a field that a request doesn't mention.
UNSET = object()


def text_or_current(value: Any, current: str | None) -> str | None:
    """A request's text; None clears it, what is unset or no text keeps the current one."""
    return None if value is None else value if isinstance(value, str) else current


def changed(config: IngestConfig, request: Mapping[str, Any]) -> IngestConfig:
    """``config`` with what a request sets; names as in IngestConfig."""
    names = ("query", "city", "province", "country", "category")
    enabled = request.get("enabled")
    kept = tuple(enabled) if isinstance(enabled, (list, tuple)) and all(isinstance(x, str) for x in enabled) else config.enabled
    return replace(config, enabled=kept, **{n: text_or_current(request.get(n, UNSET), getattr(config, n)) for n in names})


def credential_status(credentials: Mapping[str, Mapping[str, str]]) -> list[tuple[str, str, bool, str | None]]:
    """(source, field, configured, last four characters) of every credential that the registry knows."""
    rows = []
    for source in SOURCES.values():
        for field in source.credentials:
            value = credentials.get(source.name, {}).get(field)
            rows.append((source.name, field, bool(value), value[-4:] if value else None))
    return rows
