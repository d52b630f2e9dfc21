"""A client of a model server with a JSON interface, to be passed to ``ask_model``; it is sent to the tasks as it is."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class ModelClient:
    """Calls ``url``/api/generate; an error of the call is raised, and ``ask_model`` makes it the reply."""

    url: str
    model: str
    timeout: float = 120.0
    temperature: float = 0.1
    most_tokens: int = 1024

    def __call__(self, prompt: str) -> str:
        options = {"temperature": self.temperature, "num_predict": self.most_tokens}
        body = json.dumps({"model": self.model, "prompt": prompt, "stream": False, "options": options}).encode()
        request = urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply).get("response", "")

    def models(self) -> list[str] | None:
        """Names of the models that the server has; None if it does not answer."""
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=min(self.timeout, 5.0)) as reply:
                return [m["name"] for m in json.load(reply).get("models", [])]
        except (OSError, ValueError, KeyError):
            return None
