"""Interfaces of what the engine doesn't decide itself: embeddings, fetching, text models. Deterministic defaults stand in."""

from __future__ import annotations

import functools
import hashlib
import importlib
import importlib.util
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, TypeVar

import numpy as np

T = TypeVar("T")


class Embedder(Protocol):
    """Texts to rows of a float matrix. It is sent to the executors, so it must pickle."""

    dimension: int

    def embed(self, texts: list[str], normalise: bool = True) -> np.ndarray: ...


@dataclass(frozen=True)
class HashedEmbedder:
    """Signed hashed bag of words: md5 of each token names a bucket and a sign. A stand-in for a neural encoder; its scores don't compare to one's."""

    dimension: int = 64

    def embed(self, texts: list[str], normalise: bool = True) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        known: dict[str, tuple[int, int]] = {}
        for row, text in zip(out, texts, strict=True):
            for token in (text or "").lower().split():
                if token not in known:
                    digest = hashlib.md5(token.encode()).hexdigest()
                    known[token] = int(digest[:8], 16) % self.dimension, 1 - 2 * (int(digest[8], 16) % 2)
                bucket, sign = known[token]
                row[bucket] += sign
            if len(known) > 1 << 18:
                known.clear()
        if normalise and len(texts):
            size = np.sqrt((out**2).sum(1, keepdims=True))
            out = np.divide(out, size, out=np.zeros_like(out), where=size > 0)
        return out


@dataclass(frozen=True)
class LibraryEmbedder:
    """An encoder of the library ``sentence_transformers``, where that is installed; each Python worker loads it when it is first used."""

    name: str
    dimension: int = 384

    def embed(self, texts: list[str], normalise: bool = True) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dimension))
        return np.asarray(_encoder(self.name).encode([t or "" for t in texts], normalize_embeddings=normalise, show_progress_bar=False), float)


@functools.cache
def _encoder(name: str):
    return importlib.import_module("sentence_transformers").SentenceTransformer(name)


def named_embedder(name: str) -> Embedder:
    """The encoder of that name; the hashed stand-in for no name. A name whose library isn't installed is an error, not another model."""
    if not name:
        return HashedEmbedder()
    if importlib.util.find_spec("sentence_transformers") is None:
        raise ValueError(f"the encoder {name} needs the library sentence_transformers")
    return LibraryEmbedder(name)


class TextModel(Protocol):
    """A language model: instructions and a prompt to a text."""

    def complete(self, system: str, prompt: str, temperature: float, max_tokens: int) -> str: ...


@dataclass(frozen=True)
class ScriptedModel:
    """A model that answers by a function of (system, prompt); for tests and dry runs."""

    answer: Callable[[str, str], str]

    def complete(self, system: str, prompt: str, temperature: float = 0.0, max_tokens: int = 0) -> str:
        return self.answer(system, prompt)


class Fetcher(Protocol):
    """One HTTP GET: (status, final address, body). It may raise TimeoutError or any other exception."""

    def get(self, url: str, timeout: float) -> tuple[int, str, bytes]: ...


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


@dataclass(frozen=True)
class HttpFetcher:
    """The standard library's client. Without ``follow_redirects`` a redirect is its own answer."""

    user_agent: str = "Mozilla/5.0 (compatible; docmill)"
    follow_redirects: bool = True

    def get(self, url: str, timeout: float) -> tuple[int, str, bytes]:
        opener = urllib.request.build_opener(*([] if self.follow_redirects else [_Stay]))
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": self.user_agent}), timeout=timeout) as answer:
                return answer.status, answer.geturl(), answer.read()
        except urllib.error.HTTPError as e:
            return e.code, e.geturl() or url, e.read()
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError(url) from e
            raise


@dataclass(frozen=True)
class TableFetcher:
    """Pages from a dict; unknown addresses are 404. For tests and offline runs."""

    pages: dict[str, tuple[int, bytes]]

    def get(self, url: str, timeout: float = 0) -> tuple[int, str, bytes]:
        status, body = self.pages.get(url, (404, b""))
        return status, url, body


def with_retries(call: Callable[[], T], attempts: int = 3, least: float = 2.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """``call()``, tried again after 2, 4, ... seconds, ``most`` at the longest; the last failure is raised."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(most, max(least, 2.0**k)) + random.random() * 0.1)
    raise ValueError("attempts must be positive")
