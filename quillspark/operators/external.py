"""The boundary to models, judges and searches outside the engine.

A provider answers prompts; the default one is deterministic and offline.  Work is
keyed, so a run that resumes does only what its result table lacks, and a
retried task repeats its calls without repeating rows.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicons import DIMENSIONS, FACET_DIMENSIONS
from .relational import pending


class Provider(Protocol):
    def call(self, prompt: str) -> str | None: ...


class DeterministicProvider:
    """Answers with words chosen by a hash of the prompt; judges and extracts when asked for JSON."""

    def __init__(self, name: str = "stub"):
        self.name = name

    def call(self, prompt: str) -> str | None:
        h = hashlib.md5(f"{self.name}|{prompt}".encode()).hexdigest()
        return f"answer {h[:8]} of {len(prompt.split())} words"

    def call_json(self, prompt: str) -> dict | None:
        """An answer to any of the judges and extractors of ``judges``, every number from a byte of the hash."""
        h = hashlib.md5(f"{self.name}|{prompt}".encode()).digest()
        scores = lambda at, names: {d: float(1 + h[at + i] % 5) for i, d in enumerate(names)}
        checked = h[11] % 10
        return {
            "winner": "AB="[h[0] % 3], "response_a": scores(1, DIMENSIONS), "response_b": scores(6, DIMENSIONS), "scores": scores(1, FACET_DIMENSIONS), "reason": "hash",
            "claims_checked": checked, "claims_accurate": min(checked, h[12] % 10), "overall_tool_value": 1 + h[13] % 5, "needs_search": h[14] % 2 == 1, "confidence": h[15] % 10 / 10,
            "entities": [{"name": f"e{h[0] % 4}", "dravya": "thing", "guna": [f"p{h[1] % 7}"], "karma": [], "samanya": [f"c{h[2] % 3}"], "vishesha": [], "samavaya": [], "abhava": [f"g{h[3] % 5}"]}], "global_abhava": [],
        }


class FailingProvider:
    """Never answers; what a run does without its provider."""

    def call(self, prompt: str) -> str | None:
        return None

    def call_json(self, prompt: str) -> dict | None:
        return None


PROVIDERS: dict[str, Callable[..., Provider]] = {"deterministic": DeterministicProvider, "failing": FailingProvider}


def provider(name: str, *args: str) -> Callable[[], Provider]:
    """What makes the client of a registered provider, once for each task; an unknown name fails at once."""
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}, only {sorted(PROVIDERS)}")
    made = PROVIDERS[name]
    return lambda: made(*args)


def with_retries(call: Callable[[], str | None], tries: int = 3, wait: Callable[[int], float] = lambda n: 2.0 ** (n + 1), sleep: Callable[[float], None] = time.sleep) -> str | None:
    """None once all tries have failed; waits between tries."""
    for n in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001  whatever a provider raises counts as a failed call
            if n + 1 < tries:
                sleep(wait(n))
    return None


def asked_in_tasks(provider: Callable[[], Provider], ask: Callable[[Provider, str | None], object], kind: str) -> Callable[[Column], Column]:
    """A function of a prompt that asks the provider, called once a row; one client for each task.

    Python gets the prompts alone, in Spark's small batches of rows, whatever other columns a row has.
    """
    client = []

    def one(prompt):
        if not client:
            client.append(provider())
        return ask(client[0], prompt)

    return F.udf(one, kind, useArrow=False).asNondeterministic()


def answer(work: DataFrame, prompt: str, provider: Callable[[], Provider], as_json: bool = False, out: str = "answer") -> DataFrame:
    """Adds the provider's answer to each row's prompt (JSON text if ``as_json``); null where all tries fail."""
    as_text = lambda p, x: None if (found := p.call_json(x)) is None else json.dumps(found)
    one = as_text if as_json else lambda p, x: p.call(x)
    return work.withColumn(out, asked_in_tasks(provider, lambda p, x: with_retries(lambda: one(p, x)), "string")(F.col(prompt)))


def answer_distinct(work: DataFrame, prompt: str, provider: Callable[[], Provider], out: str = "answer") -> DataFrame:
    """As ``answer``, asking once for each different prompt."""
    return work.join(answer(work.select(prompt).distinct(), prompt, provider, out=out), prompt, "left")


def resume(work: DataFrame, done: DataFrame, key: str, prompt: str, provider: Callable[[], Provider]) -> DataFrame:
    """Answers for the keys that ``done`` lacks; failed ones are left out, so that a later run tries them again."""
    return answer(pending(work, done, key), prompt, provider).where(F.col("answer").isNotNull())


def tool_loop(work: DataFrame, prompt: str, provider: Callable[[], Provider], search: Callable[[str], str], most_searches: int = 3) -> DataFrame:
    """response, tool_calls, api_calls: a provider that may ask for searches ("SEARCH: query") before it answers; searches over the limit get an error."""

    def loop(p, text):
        calls, n, reply = [], 0, None
        while n <= most_searches:
            reply = with_retries(lambda t=text: p.call(t))
            n += 1
            if not (reply or "").startswith("SEARCH: "):
                break
            query = reply[8:]
            result = search(query) if len(calls) < most_searches else "error: no more searches"
            calls.append({"query": query, "result": result})
            text = f"{text}\n{result}"
        return reply, calls, n

    found = asked_in_tasks(provider, loop, "response string, tool_calls array<struct<query:string,result:string>>, api_calls int")
    names = ["response", "tool_calls", "api_calls"]
    return work.withColumn("_found", found(F.col(prompt))).select(*(c for c in work.columns if c not in names), *(F.col(f"_found.{c}") for c in names))
