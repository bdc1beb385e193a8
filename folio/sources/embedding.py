"""A client of an Ollama-like embedding server: batches, refusals, keep-alive, unloading, and which model runs."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from folio.config import EMBEDDING_MODEL
from folio.sources.cache import Refused

Transport = Callable[[str, dict | None], tuple[int, dict]]


@dataclass(frozen=True)
class Http:
    """(status, answer) of a request: a POST of JSON where there is a body, else a GET."""

    base: str = "http://localhost:11434"
    timeout: float = 600

    def __call__(self, path: str, body: dict | None = None) -> tuple[int, dict]:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.base + path, data, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout if data else 10) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            try:
                return e.code, json.loads(e.read())
            except ValueError:
                return e.code, {}


@dataclass(frozen=True)
class EmbeddingClient:
    """What `embed` calls in tasks (it travels to them by value) and what the driver asks and unloads.

    A text that is too long for the model is refused, never truncated. The model stays resident between
    batches; `unload` frees it after a build, whatever happened before, and raises nothing.
    """

    model: str = EMBEDDING_MODEL
    dims: int = 1024
    resident: str | int = "30m"
    send: Transport = Http()

    def __call__(self, texts: list[str]) -> list[list[float]]:
        """The vectors of a batch; Refused if the server will not take it, RuntimeError on any other answer."""
        if not texts:
            return []
        status, answer = self.send("/api/embed", {"model": self.model, "input": list(texts), "truncate": False, "keep_alive": self.resident})
        if status == 400:
            raise Refused(str(answer.get("error", "")))
        if status != 200:
            raise RuntimeError(f"the server answered {status}: {answer}")
        vectors = answer["embeddings"]
        if any(len(v) != self.dims for v in vectors):
            raise ValueError(f"the model gives {len(vectors[0])} dimensions, the index has {self.dims}")
        return vectors

    def query(self, text: str) -> list[float]:
        """The vector of a question; a refused question is an error that names it. The model stays loaded."""
        try:
            return self([text])[0]
        except Refused as e:
            raise Refused(f"the question was refused ({e}): {text[:60]!r}") from e

    def unload(self) -> None:
        try:
            self.send("/api/embed", {"model": self.model, "input": [""], "truncate": False, "keep_alive": 0})
        except Exception:  # noqa: BLE001 - it must not hide what went wrong before
            pass

    def running(self) -> tuple[str, str, str]:
        """(model, its digest or '', version of the server)."""
        models = self.send("/api/tags", None)[1].get("models", [])
        name = self.model.partition(":")[0]
        digest = next((m["digest"] for m in models if m["name"].partition(":")[0] == name), "")
        return self.model, digest, self.send("/api/version", None)[1].get("version", "")
