"""Interfaces to models that run elsewhere, and deterministic stand-ins for tests."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Protocol


class ModelError(RuntimeError):
    """A model can't be reached or gives what isn't an answer."""


class Embedder(Protocol):
    """Texts to vectors, one for each and in order. It is sent to the executors, so it must be picklable."""

    name: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Generator(Protocol):
    """Messages to the pieces of an answer."""

    def answer(self, messages: Sequence[dict[str, str]]) -> Iterator[str]: ...


class HashEmbedder:
    """Vectors from digests of a text's words: equal texts are equal, and shared words bring texts closer."""

    def __init__(self, dims: int = 16, name: str = "hash"):
        self.dims, self.name = dims, name

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dims
            for word in text.lower().split():
                d = hashlib.sha256(word.encode()).digest()
                v[d[0] % self.dims] += 1.0 if d[1] & 1 else -1.0
            out.append(v)
        return out


class EchoGenerator:
    """Answers with the first line of the first source."""

    def answer(self, messages: Sequence[dict[str, str]]) -> Iterator[str]:
        yield messages[-1]["content"].partition("\n")[0]


# How answers are generated.
OPTIONS = {"temperature": 0, "num_predict": 140, "num_ctx": 4096}


class HttpModels:
    """A model server over HTTP: what it has, vectors of texts, and answers as they are made. Picklable, so executors can call it."""

    def __init__(self, base: str, embedding_model: str, chat_model: str, timeout: float = 120.0):
        self.base, self.name, self.chat_model, self.timeout = base.rstrip("/"), embedding_model, chat_model, timeout

    def _open(self, path: str, payload: dict | None = None):
        data = None if payload is None else json.dumps(payload).encode()
        request = urllib.request.Request(f"{self.base}{path}", data=data, headers={"Content-Type": "application/json"})
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except (urllib.error.URLError, OSError) as e:
            raise ModelError(f"the model server can't be reached: {e}") from e

    def _json(self, path: str, payload: dict | None = None) -> dict:
        with self._open(path, payload) as got:
            try:
                return json.loads(got.read())
            except ValueError as e:
                raise ModelError(f"the model server's answer to {path} isn't JSON") from e

    def inventory(self) -> dict:
        """The server's version and the names of its models."""
        version, tags = self._json("/api/version"), self._json("/api/tags")
        return {"version": version.get("version"), "models": [m.get("name", "") for m in tags.get("models") or []]}

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        found = self._json("/api/embed", {"model": self.name, "input": list(texts), "keep_alive": "2m"}).get("embeddings")
        if not isinstance(found, list) or len(found) != len(texts):
            raise ModelError("the model server gave another number of vectors")
        return found

    def answer(self, messages: Sequence[dict[str, str]]) -> Iterator[str]:
        payload = {"model": self.chat_model, "messages": list(messages), "stream": True, "options": OPTIONS}
        with self._open("/api/chat", payload) as lines:
            for line in lines:
                if not line.strip():
                    continue
                try:
                    event = json.loads(line)
                except ValueError as e:
                    raise ModelError("a line of the model server's answer isn't JSON") from e
                if event.get("error"):
                    raise ModelError(str(event["error"]))
                if piece := (event.get("message") or {}).get("content"):
                    yield piece
                if event.get("done"):
                    return
