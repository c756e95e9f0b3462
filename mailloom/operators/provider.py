"""Language-model providers: anything callable as provider(Request) -> Reply. Calls run on the driver.

A Spark task may be run twice; a paid call must not be. Batches are few, so they are called one by
one, each with an idempotency key, and logged before the next.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

FINISHED = ("finished", "completed", "success")
LONGEST_WAIT = 30.0


@dataclass(frozen=True)
class Request:
    prompt: str
    model: str
    idempotency_key: str
    tools: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reply:
    result: str
    status: str = "finished"
    id: str | None = None
    agent_id: str | None = None
    model: Any = None
    duration_ms: int | None = None


class ProviderError(Exception):
    def __init__(self, message: str, retryable: bool = False, retry_after: float | None = None):
        super().__init__(message)
        self.retryable, self.retry_after = retryable, retry_after


Provider = Callable[[Request], Reply]


def run_status(reply: Reply) -> str:
    return str(getattr(reply.status, "value", reply.status) or "").lower()


def model_name(model: Any) -> str:
    return str(model.get("id", model) if isinstance(model, dict) else getattr(model, "id", model))


def call(provider: Provider, request: Request, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """A finished reply, within `retries` calls in all. Retryable errors wait as told, else 1, 2, 4 ... seconds,
    30 at most; a reply that ended badly is always asked for again."""
    for left in range(max(retries, 1) - 1, -1, -1):
        wait = 2.0 ** (max(retries, 1) - 1 - left)
        try:
            reply = provider(request)
            if (ended := run_status(reply)) in FINISHED:
                return reply
            raise RuntimeError(f"run ended as {ended or 'unknown'}")
        except ProviderError as e:
            if not (e.retryable and left):
                raise
            wait = min(LONGEST_WAIT, wait if e.retry_after is None else e.retry_after)
        except RuntimeError:
            if not left:
                raise
        sleep(wait)
    raise AssertionError


def parse_object(text: str) -> dict:
    """The JSON object of an answer: bare, fenced, or after other words."""
    t = text.strip()
    if t.startswith("```") and "\n" in t:
        inner = t.split("\n", 1)[1]
        t = inner.rsplit("```", 1)[0].strip() if "```" in inner else inner.strip()
    try:
        found = json.loads(t)
    except ValueError:
        decoder, at = json.JSONDecoder(), t.find("{")
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(t, at)
                break
            except ValueError:
                at = t.find("{", at + 1)
        else:
            raise ValueError("no JSON object in the answer") from None
    if not isinstance(found, dict):
        raise TypeError("the answer is not a JSON object")
    return found


@dataclass
class OfflineProvider:
    """Answers from a function of the phase and the payload; keeps what it was asked."""

    answer: Callable[[str, dict], Any]
    asked: list[Request] = field(default_factory=list)

    def __call__(self, request: Request) -> Reply:
        self.asked.append(request)
        phase = request.idempotency_key.split(":")[3]
        payload = json.loads(request.prompt.split("<<<DATA\n", 1)[1].rsplit("\nDATA>>>", 1)[0])
        return Reply(json.dumps(self.answer(phase, payload)), id=f"run-{len(self.asked)}", agent_id="offline", model=request.model, duration_ms=0)

    def models(self) -> list[dict[str, str]]:
        return [{"id": "offline", "name": "Offline"}]
