"""Judges: callables of chat messages to text. The recorded one needs no network and is the default."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from urllib import request

from storyscale.functions.lexicon import STORY_DIMENSIONS


def recorded(score: int = 1, dims: tuple[str, ...] = STORY_DIMENSIONS):
    """A judge that gives every text the same score, for tests and dry runs."""
    reply = json.dumps({d: {"score": score, "justification": "Recorded."} for d in dims})
    return lambda messages: reply


@dataclass(frozen=True)
class ChatJudge:
    """A chat completion service: ``style`` openai (also for compatible gateways) or anthropic."""

    url: str
    model: str
    key: str
    style: str = "openai"
    max_tokens: int = 2000
    timeout: float = 120.0

    def body(self, messages: list[dict]) -> dict:
        if self.style == "openai":
            return {"model": self.model, "messages": messages, "temperature": 0.0, "max_tokens": self.max_tokens}
        system = "\n".join(m["content"] for m in messages if m["role"] == "system")
        return {"model": self.model, "system": system, "messages": [m for m in messages if m["role"] != "system"], "temperature": 0.0, "max_tokens": self.max_tokens}

    def headers(self) -> dict[str, str]:
        auth = {"Authorization": f"Bearer {self.key}"} if self.style == "openai" else {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
        return {"Content-Type": "application/json", **auth}

    def __call__(self, messages: list[dict]) -> str:
        req = request.Request(self.url, json.dumps(self.body(messages)).encode(), self.headers())
        with request.urlopen(req, timeout=self.timeout) as r:
            out = json.load(r)
        return out["choices"][0]["message"]["content"] if self.style == "openai" else "".join(c.get("text", "") for c in out["content"])


def resolve(provider: str | None, model: str | None, environ=os.environ) -> ChatJudge:
    """The service of a provider, or of the first one with a key: gateway, openai, anthropic."""
    found = {
        "gateway": (environ.get("JUDGE_BASE_URL", ""), environ.get("JUDGE_API_KEY", ""), "openai"),
        "openai": ("https://api.openai.com/v1/chat/completions", environ.get("OPENAI_API_KEY", ""), "openai"),
        "anthropic": ("https://api.anthropic.com/v1/messages", environ.get("ANTHROPIC_API_KEY", ""), "anthropic"),
    }
    name = provider or next((n for n, (url, key, _) in found.items() if url and key), None)
    if name not in found or not found[name][1]:
        raise ValueError(f"no key for the judge provider {name or '(none given)'}")
    model = model or environ.get("JUDGE_MODEL")
    if not model:
        raise ValueError("name the judge's model")
    url, key, style = found[name]
    return ChatJudge(url, model, key, style)
