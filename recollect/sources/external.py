"""External memories: services that retain sessions, become ready some time later, recall under a budget, and forget.

A client is what a service's library offers; calls run in tasks, batch by batch, so that a corpus of sessions is retained and
asked by many tasks at once. What a service answers comes back as rows; nothing is held on the driver. ``FolderMemory`` is
a stub whose documents are files in a folder that all tasks share.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as X

NS = "namespace"
DONE, FAILED = {"done", "completed"}, {"failed", "error"}
RETAINED = "namespace string, source_id string, document_id string, error string"
READY = "namespace string, source_id string, document_id string, status string, polls int"
RECALLED = "query_id string, namespace string, context string, context_tokens long, sources array<string>, n_candidates int, error string"
MOST_RESULTS = 100


class Client(Protocol):
    """What is asked of a service. Each call may raise; it is tried once more."""

    def retain(self, namespace: str, source_id: str, text: str, metadata: dict[str, str]) -> str: ...

    def status(self, namespace: str, document_id: str) -> str: ...

    def recall(self, namespace: str, query: str, limit: int) -> list[dict[str, Any]]: ...

    def delete(self, namespace: str) -> int: ...

    def health(self) -> bool: ...


class FolderMemory:
    """A stub: a document is a file, ready after some polls; the best results share most words with the query."""

    def __init__(self, folder: str, polls: int = 2):
        if "://" in folder:
            raise ValueError("the stub keeps files, so its folder has to be a path")
        self.folder, self.polls = folder, polls

    def _at(self, namespace: str, name: str = "") -> str:
        return os.path.join(self.folder, hashlib.md5(namespace.encode()).hexdigest(), name)

    def health(self) -> bool:
        return os.path.isdir(self.folder)

    def retain(self, namespace: str, source_id: str, text: str, metadata: dict[str, str]) -> str:
        document = hashlib.md5(f"{namespace}:{source_id}".encode()).hexdigest()
        os.makedirs(self._at(namespace), exist_ok=True)
        whole = json.dumps({"source_id": source_id, "text": text, "metadata": metadata})
        with open(self._at(namespace, f".{document}"), "w") as f:  # a task that runs again writes the same file
            f.write(whole)
        os.replace(self._at(namespace, f".{document}"), self._at(namespace, document))
        return document

    def status(self, namespace: str, document_id: str) -> str:
        if not os.path.exists(self._at(namespace, document_id)):
            return "failed"
        with open(self._at(namespace, f".polls-{document_id}"), "a+") as f:
            f.write(".")
            f.flush()
            return "done" if f.tell() >= self.polls else "queued"

    def recall(self, namespace: str, query: str, limit: int) -> list[dict[str, Any]]:
        words = set(re.findall("[a-z0-9]+", query.lower()))
        found = []
        for name in os.listdir(self._at(namespace)) if os.path.isdir(self._at(namespace)) else []:
            if not name.startswith("."):
                with open(self._at(namespace, name)) as f:
                    document = json.load(f)
                shared = len(words & set(re.findall("[a-z0-9]+", document["text"].lower())))
                if shared:
                    found.append((-shared, document["source_id"], document))
        return [d for *_, d in sorted(found, key=lambda x: x[:2])[:limit]]

    def delete(self, namespace: str) -> int:
        names = os.listdir(self._at(namespace)) if os.path.isdir(self._at(namespace)) else []
        for name in names:
            os.remove(self._at(namespace, name))
        return sum(not n.startswith(".") for n in names)


def _tried(call: Callable[[], Any]) -> Any:
    """call, once more if it raises."""
    try:
        return call()
    except Exception:  # noqa: BLE001  whatever a client raises
        return call()


def session_texts(turns: DataFrame) -> DataFrame:
    """(namespace, source_id, text): a session's turns as lines, in order."""
    line = X.turn_line(F.col("role"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("turn_id", line.alias("line"))))
    return turns.groupBy(NS, F.col("session_id").alias("source_id")).agg(F.array_join(F.transform(ordered, lambda t: t["line"]), "\n").alias("text"))


def retained(sessions: DataFrame, client: Client) -> DataFrame:
    """sessions (namespace, source_id, text) handed to the service: the document of each, or the error.

    Rows are made as they are read: write the result once, and read that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    out.append((r.namespace, r.source_id, _tried(lambda r=r: client.retain(r.namespace, r.source_id, r.text, {"session_id": r.source_id})), None))
                except Exception as why:  # noqa: BLE001
                    out.append((r.namespace, r.source_id, None, str(why)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RETAINED.split(", ")])

    return sessions.select(NS, "source_id", "text").mapInPandas(run, RETAINED)


def readiness(documents: DataFrame, client: Client, timeout_s: float = 30.0, interval_s: float = 0.05) -> DataFrame:
    """documents (namespace, source_id, document_id) with what became of them: ``done``, ``failed`` or, where the time was
    not enough, ``timeout``. A batch of documents is polled together, again and again until none is open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch[[NS, "source_id", "document_id"]].itertuples(index=False))
            state, polls, until = {}, [0] * len(rows), time.monotonic() + timeout_s
            while len(state) < len(rows):
                for i, r in enumerate(rows):
                    if i in state:
                        continue
                    polls[i] += 1
                    said = _tried(lambda r=r: client.status(r.namespace, r.document_id)).lower() if r.document_id else "failed"
                    if said in DONE | FAILED:
                        state[i] = "done" if said in DONE else "failed"
                if len(state) < len(rows) and time.monotonic() >= until:
                    state |= {i: "timeout" for i in range(len(rows)) if i not in state}
                elif len(state) < len(rows):
                    time.sleep(min(interval_s, max(0.0, until - time.monotonic())))
            yield pd.DataFrame([(*r, state[i], polls[i]) for i, r in enumerate(rows)], columns=[c.split()[0] for c in READY.split(", ")])

    return documents.mapInPandas(run, READY)


def packed(texts: list[str], budget: int) -> list[int]:
    """The numbers of the texts that fit the budget as ``- text`` lines, each taken if it still does."""
    used, kept = 0, []
    for i, text in enumerate(texts):
        cost = max(1, len(f"- {text}") // 4)
        if used + cost <= budget:
            used, kept = used + cost, [*kept, i]
    return kept


def recalled(queries: DataFrame, client: Client, limit: int = MOST_RESULTS) -> DataFrame:
    """queries (query_id, namespace, query, budget_tokens) with the context that the service's results make, in its order, as
    far as each fits, and where they come from. A result without text is an error of the service, and so is a failed call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    found = _tried(lambda r=r: client.recall(r.namespace, r.query, limit))
                    if not all((x.get("text") or "").strip() for x in found):
                        raise ValueError("a result without text")
                    kept = packed([x["text"] for x in found], r.budget_tokens)
                    context = "\n".join(f"- {found[i]['text']}" for i in kept)
                    out.append((r.query_id, r.namespace, context, max(1, len(context) // 4) if context else 0, [found[i].get("source_id") or "unknown" for i in kept], len(found), None))
                except Exception as why:  # noqa: BLE001
                    out.append((r.query_id, r.namespace, None, 0, [], 0, str(why)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECALLED.split(", ")])

    return queries.select("query_id", NS, "query", "budget_tokens").mapInPandas(run, RECALLED)


def forgotten(namespaces: DataFrame, client: Client) -> DataFrame:
    """namespaces (namespace) with how many documents the service deleted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({NS: batch[NS], "deleted": [_tried(lambda n=n: client.delete(n)) for n in batch[NS]]})

    return namespaces.select(NS).distinct().mapInPandas(run, "namespace string, deleted long")
