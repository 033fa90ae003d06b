"""Model services: settings, routing between a cheap and a thorough one, and a client for chat-completion interfaces."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from lodestack.functions import vocabulary as V
from lodestack.functions.replies import short_model_name


@dataclass(frozen=True)
class ModelSettings:
    """Which services answer; made from an environment by :func:`settings_of`."""

    provider: str = "ollama"
    deep_provider: str | None = None
    model: str = ""
    deep_model: str | None = None
    timeout: float = 120.0
    base_urls: Mapping[str, str] = field(default_factory=dict)
    api_key: str = ""
    embedding_model: str = ""


def settings_of(environment: Mapping[str, str]) -> ModelSettings:
    """Settings from environment variables (see MODEL_SETTINGS for names and defaults)."""
    get = lambda name: environment.get(name, V.MODEL_SETTINGS[name]).strip()
    urls = {"ollama": get("OLLAMA_BASE_URL"), "llamacpp": get("LLAMACPP_BASE_URL"), "hosted": get("HOSTED_BASE_URL")}
    return ModelSettings(
        get("LLM_PROVIDER").lower(), get("LLM_DEEP_PROVIDER").lower() or None, get("LLM_MODEL"), get("LLM_DEEP_MODEL") or None,
        float(get("LLM_TIMEOUT_SECONDS")), urls, get("HOSTED_API_KEY"), short_model_name(get("EMBEDDING_MODEL")),
    )


@dataclass(frozen=True)
class ChatService:
    """A client of one chat-completions interface: a :class:`lodestack.plugins.Judge` that workers can hold.

    ``extra`` goes into every request's body.
    """

    name: str
    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 120.0
    extra: Mapping[str, Any] = field(default_factory=dict)
    temperature: float = 0.2

    def __post_init__(self) -> None:
        if not self.base_url:
            raise ValueError(f"{self.name} needs a base URL")

    def _ask(self, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}{path}", data=data, headers=headers)
        # a proxy of the environment must not stand between workers and a local service
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
        with opener.open(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def _message(self, prompt: str, **more: Any) -> dict[str, Any]:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], **more, **self.extra}
        return self._ask("/v1/chat/completions", body)["choices"][0]["message"]

    def complete(self, prompt: str, max_tokens: int, as_json: bool = False) -> str:
        """The answer to a prompt, as a JSON object if asked for."""
        form = {"response_format": {"type": "json_object"}} if as_json else {}
        return self._message(prompt, temperature=self.temperature, max_tokens=max_tokens, **form).get("content") or ""

    def call_tools(self, prompt: str, tools: list[dict[str, Any]]) -> tuple[str, list[tuple[str, dict[str, Any]]]]:
        """The answer, and which tools it calls with which arguments."""
        told = self._message(prompt, tools=tools, tool_choice="auto")
        calls = [(c["function"]["name"], json.loads(c["function"]["arguments"] or "{}")) for c in told.get("tool_calls") or []]
        return told.get("content") or "", calls

    def healthy(self) -> bool:
        """Whether the service answers at all."""
        try:
            self._ask("/v1/models")
            return True
        except (OSError, ValueError):
            return False


def service(name: str, settings: ModelSettings) -> ChatService:
    """The named service."""
    name = name.strip().lower()
    if name not in ("ollama", "llamacpp", "hosted"):
        raise ValueError(f"unknown model service {name!r}; there are ollama, llamacpp and hosted")
    made = ChatService(name, settings.base_urls.get(name, ""), settings.model, timeout=settings.timeout)
    if name == "hosted":
        if not settings.api_key:
            raise ValueError("hosted needs an API key")
        return replace(made, api_key=settings.api_key)
    # thinking models would spend their tokens before they answer
    return replace(made, extra={"reasoning_effort": "none"}) if name == "ollama" else made


def triage_service(settings: ModelSettings) -> ChatService:
    """The service for many small questions."""
    return service(settings.provider, settings)


def deep_service(settings: ModelSettings) -> ChatService:
    """The service for research; the triage one unless another service or model is set."""
    made = service(settings.deep_provider or settings.provider, settings)
    return replace(made, model=settings.deep_model) if settings.deep_model else made


def require(*services: ChatService) -> None:
    """Fail before a long job begins if a service that it needs is down."""
    if down := [s.name for s in services if not s.healthy()]:
        raise ConnectionError(f"no answer from {', '.join(down)}")
