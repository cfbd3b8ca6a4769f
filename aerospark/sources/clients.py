"""Model clients that run inside tasks: a function on the executor, or a remote endpoint."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

# Fixed set of HTTP statuses that are worth another attempt.
RETRYABLE = frozenset({429, 500, 502, 503, 504})

Transport = Callable[[str, dict, dict, float], tuple[int, str]]


@dataclass
class InClusterClient:
    """Calls ``infer_fn(context, model)`` in the task; its answer must be a dict.

    ``infer_batch(contexts, model)``, if given, answers many at once, which suits an accelerator.
    """

    infer_fn: Callable[[dict, str], dict] | None = None
    infer_batch: Callable[[list[dict], str], list[dict]] | None = None

    def infer(self, context: dict, model: str) -> dict:
        if self.infer_fn is None:
            raise RuntimeError("in-cluster inference needs an infer_fn")
        result = self.infer_fn(context, model)
        if not isinstance(result, dict):
            raise TypeError(f"infer_fn must return a dict, not {type(result).__name__}")
        return result


def http_post(url: str, payload: dict, headers: dict, timeout: float) -> tuple[int, str]:
    """One POST with the standard library: status and body, also for error statuses."""
    request = urllib.request.Request(
        url, data=json.dumps(payload).encode(), headers=headers, method="POST"
    )
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as error:
        return error.code, ""
    except urllib.error.URLError as error:
        raise ConnectionError(str(error.reason)) from error


@dataclass
class RemoteClient:
    """Posts contexts to an endpoint, with retries and doubling pauses."""

    url: str
    api_key: str | None = None
    timeout: float = 30.0
    max_retries: int = 3
    backoff: float = 0.5
    transport: Transport = http_post
    sleep: Callable[[float], None] = field(default=time.sleep)

    def infer(self, context: dict, model: str) -> dict:
        headers = {"Content-Type": "application/json"}
        if self.api_key:
            headers["Authorization"] = f"Bearer {self.api_key}"
        problem: object = None
        for tried in range(self.max_retries + 1):
            if tried:
                self.sleep(self.backoff * 2 ** (tried - 1))
            try:
                status, body = self.transport(
                    self.url, {"model_name": model, "context": context}, headers, self.timeout
                )
            except (TimeoutError, ConnectionError) as error:
                problem = error
                continue
            if status in RETRYABLE:
                problem = f"HTTP status {status}"
            elif status >= 400:
                raise RuntimeError(f"inference refused: HTTP status {status}")
            else:
                return json.loads(body)
        raise RuntimeError(f"the endpoint gave no answer in {self.max_retries + 1} tries; the last said: {problem}")
