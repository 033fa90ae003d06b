"""What language models answer, read by plain Python; applied to rows by the operators that ask them."""

from __future__ import annotations

import json
import re
from typing import Any

from lodestack.functions import vocabulary as V


class ReplyError(ValueError):
    """An answer that holds nothing usable."""


def required(answer: str | None) -> str:
    """The answer itself; ReplyError if there is none."""
    if not (answer or "").strip():
        raise ReplyError("the model gave an empty answer")
    return answer


def _outer(answer: str, opening: str, closing: str) -> str | None:
    """From the first opening mark to the last closing one."""
    begin, end = answer.find(opening), answer.rfind(closing)
    return answer[begin : end + 1] if 0 <= begin < end else None


def _decoded(text: str | None) -> Any:
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def first_object(answer: str) -> dict[str, Any]:
    """The JSON object that begins at the first brace, whatever follows it; else the one between the outermost braces."""
    begin = answer.find("{")
    if begin >= 0:
        try:
            told, _ = json.JSONDecoder().raw_decode(answer, begin)
            return told
        except ValueError:
            pass
    told = _decoded(_outer(answer, "{", "}"))
    if not isinstance(told, dict):
        raise ReplyError("no JSON object in the answer")
    return told


def _texts(value: Any) -> list[str]:
    return [v.strip() for v in value if isinstance(v, str) and v.strip()]


def planned(answer: str) -> list[tuple[str, str]]:
    """(track, query) of a planner's answer: two of each track at most, six in all.

    An answer that is a plain list of texts, without an object, holds general queries only.
    """
    told = _decoded(_outer(required(answer), "{", "}"))
    made: list[tuple[str, str]] = []
    if isinstance(told, dict):
        for track, key in V.PLAN_KEYS.items():
            if isinstance(told.get(key), list):
                made += [(track, q) for q in _texts(told[key])[: V.PLANNED_PER_TRACK]]
        if made or any(isinstance(told.get(k), list) for k in V.PLAN_KEYS.values()):
            return made[: V.PLANNED_QUERIES]
    listed = _decoded(_outer(answer, "[", "]"))
    if not isinstance(listed, list) or not all(isinstance(q, str) for q in listed):
        raise ReplyError("no list of queries in the answer")
    return [("blended", q) for q in _texts(listed)][: V.PLANNED_QUERIES]


def _short_list(value: Any) -> list[str]:
    if not isinstance(value, list):
        return []
    return [t for t in (str(v).strip() for v in value) if t][:8]


def _items(value: Any, section: str) -> list[dict[str, Any]]:
    """Items as they are claimed, for the operators that check what they cite; malformed ones are left out."""
    made = []
    for place, item in enumerate(value if isinstance(value, list) else []):
        if isinstance(item, dict):
            index = item.get("evidenceIndex")
            whole = isinstance(index, int) and not isinstance(index, bool)
            as_text = lambda v: None if v is None else str(v)
            made.append({
                "section": section, "place": place, "claim": str(item.get("claim", "")).strip(), "specificity": as_text(item.get("specificity")),
                "corroboration": as_text(item.get("corroboration")), "evidence_index": str(index) if whole else None,
            })
    return made


def intel_of(answer: str) -> dict[str, Any]:
    """A synthesis as summary, lists, notes, sentiment and claimed items; ReplyError without an object or a summary."""
    told = first_object(required(answer))
    text = lambda key, default="": str(told.get(key, default)).strip()
    if not text("summary"):
        raise ReplyError("the synthesis has no summary")
    mood = text("sentiment", "unknown").lower()
    return {
        "summary": text("summary"), "known_for": _short_list(told.get("knownFor")), "notable_projects": _short_list(told.get("notableProjects")),
        "reputation_notes": text("reputationNotes") or V.NO_REPUTATION, "sentiment": mood if mood in V.SENTIMENT_SCORES else "unknown",
        "items": _items(told.get("positiveItems"), "positive") + _items(told.get("negativeItems"), "negative"),
    }


def verdict(answer: str) -> tuple[str, str | None]:
    """Verdict and evidence of a judge's answer; anything but a clear verdict is uncertain."""
    told = _decoded(_outer(answer, "{", "}"))
    if isinstance(told, dict):
        said = str(told.get("verdict") or "").lower()
        if said in ("pass", "fail", "uncertain"):
            evidence = told.get("evidence")
            return said, ("" if evidence is None else str(evidence)).strip()[:500] or None
    return "uncertain", answer.strip()[:500] or None


def short_model_name(name: str) -> str:
    """A model's full name; short names of the known family get their publisher."""
    return f"{V.MODEL_PUBLISHER}/{name}" if re.match(V.MODEL_FAMILY, name) else name
