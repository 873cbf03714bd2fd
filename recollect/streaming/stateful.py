"""Streams with keyed state of several parts: whole client views aligned with what is stored, and a live window with a
bounded overflow buffer.

State lives in maps, lists and counters of a state store that keeps what does not change on disk, so an update costs what
it touches and not the length of the conversation. These operators need the RocksDB state store (``rocksdb``).
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recollect.streaming.memory import INGESTED, _tokens

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HIGH, LOW, BUFFER_TURNS = 16000, 12000, 20
WINDOW_EVENTS = "namespace string, event string, first_turn bigint, last_turn bigint, n_turns bigint, tokens bigint, text string, dropped_turns bigint"


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Inside, streams that start keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# --- Whole views ---


def mark(role: str | None, content: str | None) -> bytes:
    """16 bytes that stand for a message."""
    parts = [b"-" if x is None else b"+" + x.encode() for x in (role, content)]
    return hashlib.blake2b(len(parts[0]).to_bytes(4, "big") + parts[0] + parts[1], digest_size=16).digest()


def known(incoming: list[bytes], stored: list[bytes]) -> int:
    """How many of the incoming messages are stored already: the largest i for which the first i messages end like the
    stored ones, as far back as both reach; 0 if there is none.

    One pass with the failure function of the stored messages finds the last place where all of them occur; failing that,
    one with that of the incoming ones finds how many of those the stored messages end with."""

    def failures(pattern: list[bytes]) -> list[int]:
        out, k = [0] * len(pattern), 0
        for i in range(1, len(pattern)):
            while k and pattern[i] != pattern[k]:
                k = out[k - 1]
            k += pattern[i] == pattern[k]
            out[i] = k
        return out

    def lengths(pattern: list[bytes], text: list[bytes]) -> Iterator[int]:
        """At each place of text, how much of pattern's beginning ends there."""
        fail, k = failures(pattern), 0
        for x in text:
            if k == len(pattern):
                k = fail[k - 1]
            while k and pattern[k] != x:
                k = fail[k - 1]
            k += pattern[k] == x
            yield k

    if not stored or not incoming:
        return 0
    whole = [i + 1 for i, k in enumerate(lengths(stored, incoming)) if k == len(stored)]
    if whole:
        return whole[-1]
    last = 0
    for last in lengths(incoming, stored):  # noqa: B007  the last one counts
        pass
    return last


class _Aligner(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getListState("said", "mark binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored, before = [bytes(m[0]) for m in self.said.get()], 0
        before, out = len(stored), []
        for view in sorted((r for batch in rows for r in batch.to_dict("records")), key=lambda r: (r["sent"], len(r["messages"]))):
            messages = [(m["role"], m["content"]) for m in view["messages"]]
            marks = [mark(*m) for m in messages]
            n = known(marks, stored)
            for (role, content), own in zip(messages[n:], marks[n:], strict=True):
                stored.append(own)
                out.append((key[0], len(stored), role, content, _tokens(content)))
        if out:
            self.said.appendList([(m,) for m in stored[before:]])
            yield pd.DataFrame(out, columns=["namespace", "turn_id", "role", "content", "tokens"])

    def close(self) -> None: ...


def aligned(views: DataFrame) -> DataFrame:
    """views (namespace, sent, messages array<struct<role, content>>), each what a client holds of a session at that time,
    as turns: each message once, with ids from 1, whatever the views repeat.

    A view's messages that the stored ones end with are known, and what follows them is new (``known``); a view that fits
    nowhere is new as a whole. The state is a list of marks that is only ever added to. Views of one batch are taken in
    the order in which they were sent."""
    return views.groupBy("namespace").transformWithStateInPandas(_Aligner(), INGESTED, "Append", "None")


# --- The live window ---


class _Window(StatefulProcessor):
    def __init__(self, extract: Callable[[str], str], high: int, low: int, buffer_turns: int, deferred_ms: int | None):
        self.extract, self.high, self.low, self.buffer_turns, self.deferred_ms = extract, high, low, buffer_turns, deferred_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "n bigint", "turn_id bigint, line string, tokens bigint")
        # From head to the buffer's end turns wait, from there to tail they are live.
        self.marks = handle.getValueState("marks", "head bigint, live bigint, tail bigint, tokens bigint, dropped bigint")

    def _leave(self, head: int, end: int) -> list[tuple]:
        """The turns from head to end, which are no longer kept."""
        gone = [self.turns.getValue((n,)) for n in range(head, end)]
        for n in range(head, end):
            self.turns.removeKey((n,))
        return gone

    def _worked(self, key, head: int, end: int, dropped: int) -> tuple[tuple, int]:
        """What is made of the waiting turns: extraction is tried twice, then they are dropped and counted."""
        gone = self._leave(head, end)
        text, event = None, "dropped"
        for _ in range(2):
            try:
                text, event = self.extract("\n".join(line for _, line, _ in gone)), "extracted"
                break
            except Exception:  # noqa: BLE001  whatever a provider raises
                continue
        dropped += len(gone) * (event == "dropped")
        return (key[0], event, gone[0][0], gone[-1][0], len(gone), sum(t for *_, t in gone), text, dropped), dropped

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head, live, tail, tokens, dropped = self.marks.get() if self.marks.exists() else (0, 0, 0, 0, 0)
        out = []
        for row in sorted((r for batch in rows for r in batch.to_dict("records")), key=lambda r: r["turn_id"]):
            self.turns.updateValue((tail,), (int(row["turn_id"]), f"{row['role'].upper()}: {row['content']}", int(row["tokens"])))
            tail, tokens = tail + 1, tokens + int(row["tokens"])
            if tokens <= self.high:
                continue
            first, size = live, 0
            while tokens > self.low and live < tail - 1:
                left = self.turns.getValue((live,))
                live, tokens, size = live + 1, tokens - left[2], size + left[2]
            if live == first:
                continue
            out.append((key[0], "evicted", self.turns.getValue((first,))[0], self.turns.getValue((live - 1,))[0], live - first, size, None, dropped))
            if self.deferred_ms is None:
                event, dropped = self._worked(key, head, live, dropped)
                out.append(event)
                head = live
                continue
            if live - head > self.buffer_turns:  # full: the oldest are lost, and counted
                lost = self._leave(head, live - self.buffer_turns)
                head, dropped = live - self.buffer_turns, dropped + len(lost)
                out.append((key[0], "overflowed", lost[0][0], lost[-1][0], len(lost), sum(t for *_, t in lost), None, dropped))
        if self.deferred_ms is not None and live > head and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.deferred_ms)
        self.marks.update((head, live, tail, tokens, dropped))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW_EVENTS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head, live, tail, tokens, dropped = self.marks.get()
        if live > head:
            event, dropped = self._worked(key, head, live, dropped)
            self.marks.update((live, live, tail, tokens, dropped))
            yield pd.DataFrame([event], columns=[c.split()[0] for c in WINDOW_EVENTS.split(", ")])

    def close(self) -> None: ...


def live_window(turns: DataFrame, extract: Callable[[str], str], high: int = HIGH, low: int = LOW, buffer_turns: int = BUFFER_TURNS, deferred_ms: int | None = None) -> DataFrame:
    """turns (namespace, turn_id, role, content, tokens) as what happens to a live window of their tokens.

    When a turn brings the window above high, its oldest turns leave until it holds no more than low (event ``evicted``);
    the newest turn always stays. Turns that have left wait in a buffer for extract, at once or, with deferred_ms, until a timer
    of that many milliseconds; the buffer then holds buffer_turns turns at most, and the oldest beyond are lost
    (``overflowed``). Extraction is tried twice (``extracted``), then the turns are given up (``dropped``). Every event carries
    how many turns its namespace has lost so far. Turns, buffer and counters survive a restart."""
    mode = "None" if deferred_ms is None else "ProcessingTime"
    return turns.groupBy("namespace").transformWithStateInPandas(_Window(extract, high, low, buffer_turns, deferred_ms), WINDOW_EVENTS, "Append", mode)
