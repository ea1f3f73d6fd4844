"""A language model behind one call; the client library is optional and any other callable will do."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

DEFAULT_MODEL = "gpt-4o"


@dataclass(frozen=True)
class Model:
    """Answers of a named model, as deterministic as it allows; the empty text where it fails, so nothing is written then.

    ``complete`` takes keyword arguments ``model``, ``messages`` and ``temperature`` (and ``api_key`` if there is one) and
    returns an object like those of ``litellm.completion``, which is the default. Instances travel to executors.
    """

    name: str = DEFAULT_MODEL
    api_key: str | None = None
    complete: Callable | None = None

    @classmethod
    def from_config(cls, config: dict | None, complete: Callable | None = None) -> Model:
        config = config or {}
        return cls(config.get("model", DEFAULT_MODEL), config.get("api_key"), complete)

    def __call__(self, system: str, user: str) -> str:
        complete = self.complete
        if complete is None:
            try:
                from litellm import completion as complete
            except ImportError:
                raise ImportError("litellm is required to ask a model; install it or pass another client") from None
        given = {"model": self.name, "temperature": 0.0, "messages": [{"role": r, "content": c} for r, c in (("system", system), ("user", user))]}
        try:
            answer = complete(**given, **({"api_key": self.api_key} if self.api_key else {}))
            return answer.choices[0].message.content or ""
        except Exception as e:  # any provider's error
            print(f"model {self.name}: {e}", file=sys.stderr)
            return ""
