"""What is injected: chat, embedding and judging functions, memory arms, selectors. Stubs are deterministic.

A provider runs inside Arrow-batched functions on executors, so it must be a plain, serialisable callable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame

Chat = Callable[[list[dict[str, str]]], str]
Embed = Callable[[list[str]], list[list[float]]]
Judge = Callable[[str, str], bool]


class Selector(Protocol):
    """Which candidates of a memory a request gets."""

    def __call__(self, queries: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame) -> DataFrame: ...


class MemoryArm(Protocol):
    """A memory under test."""

    name: str

    def ingest(self, turns: DataFrame) -> None: ...

    def await_ready(self, timeout_s: float) -> bool: ...

    def recall(self, queries: DataFrame) -> DataFrame: ...

    def stats(self) -> dict[str, Any]: ...

    def reset(self, namespace: str) -> None: ...


def stub_embed(size: int = 32) -> Embed:
    """Hashed character trigrams, scaled to length 1: similar texts have similar vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(size)
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=4).digest(), "little")
                v[h % size] += 1.0 if h >> 31 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out

    return embed


def stub_judge(verdict: bool = False) -> Judge:
    return lambda a, b: verdict


def stub_summary(limit: int = 200) -> Chat:
    """The beginning of the last message."""
    return lambda messages: messages[-1]["content"][:limit]


def stub_extract(refused: str) -> Callable[[str], str]:
    """The first line of a text; an error for texts that hold the refused word."""

    def extract(text: str) -> str:
        if refused in text:
            raise RuntimeError("no answer")
        return text.split("\n")[0]

    return extract


def stub_reader(answer_key: dict[str, str]) -> Callable[[str, str], bool]:
    """Whether the gold answer of a question stands in the context."""
    return lambda question, context: answer_key.get(question, "\0").lower() in context.lower()


def bounded_retry(call: Callable[..., Any], times: int = 1) -> Callable[..., Any]:
    """call again, times times at most, when it raises."""

    def run(*args, **kwargs):
        for left in range(times, -1, -1):
            try:
                return call(*args, **kwargs)
            except Exception:
                if not left:
                    raise

    return run
