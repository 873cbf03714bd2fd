"""Streaming ingestion: turns once and in order per namespace, and compaction as state.

State is keyed by namespace, so updates of one conversation are serial and the locks and races of a shared file do not
exist. Replayed messages are dropped by their arrival number; a restart continues from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions import constants as C
from recollect.operators.fold import Fact, Ledger

INGESTED = "namespace string, turn_id bigint, role string, content string, tokens bigint"
COMPACTED = "namespace string, event string, turn_ids array<bigint>, text string, tokens bigint"


def _tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def ingested(messages: DataFrame) -> DataFrame:
    """messages (namespace, arrival_seq, role, content) as turns with ids from 1: each arrival number once, in order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_seq, last_turn = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values("arrival_seq", kind="stable").drop_duplicates("arrival_seq")
        rows = rows[rows["arrival_seq"] > last_seq]
        if len(rows):
            ids = range(last_turn + 1, last_turn + 1 + len(rows))
            state.update((int(rows["arrival_seq"].iloc[-1]), last_turn + len(rows)))
            yield pd.DataFrame({"namespace": key[0], "turn_id": ids, "role": rows["role"].to_numpy(), "content": rows["content"].to_numpy(), "tokens": [_tokens(t) for t in rows["content"]]})

    return messages.groupBy("namespace").applyInPandasWithState(run, INGESTED, "last_seq bigint, last_turn bigint", "append", GroupStateTimeout.NoTimeout)


def compacting(turns: DataFrame, summarise: Callable[[str], str], trigger: int = C.TRIGGER_TOKENS, size: int = C.SPAN_TURNS, keep: int = C.KEEP_TURNS) -> DataFrame:
    """turns as they come, with the summaries of the spans that leave: events ``summary`` and ``failed``.

    While a namespace holds more tokens than the trigger, its oldest span becomes a summary. If summarise raises an
    error the state stays as it was, and the next batch tries again."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, lines, tokens = (list(x) for x in state.get) if state.exists else ([], [], [])
        for batch in batches:
            for row in batch.sort_values("turn_id", kind="stable").to_dict("records"):
                ids.append(int(row["turn_id"]))
                lines.append(f"{row['role'].upper()}: {row['content']}")
                tokens.append(int(row["tokens"]))
        out = []
        while sum(tokens) > trigger and len(ids) > keep:
            n = min(size, len(ids) - keep)
            try:
                text = summarise("\n".join(lines[:n]))
            except Exception:  # noqa: BLE001  whatever a provider raises: nothing has changed yet
                out.append((key[0], "failed", ids[:n], None, 0))
                break
            out.append((key[0], "summary", ids[:n], text, _tokens(text)))
            ids, lines, tokens = ids[n:], lines[n:], tokens[n:]
        state.update((ids, lines, tokens))
        if out:
            yield pd.DataFrame(out, columns=["namespace", "event", "turn_ids", "text", "tokens"])

    return turns.groupBy("namespace").applyInPandasWithState(run, COMPACTED, "ids array<bigint>, lines array<string>, tokens array<bigint>", "append", GroupStateTimeout.NoTimeout)


def superseding(facts: DataFrame, max_stale: int = C.MAX_STALE) -> DataFrame:
    """facts (namespace, seq, text, source_turn_id, slot_key, slot_value) as changes of the current value of their slot: event ``active`` or ``stale`` with the superseding turn."""
    out_schema = "namespace string, event string, slot_key string, slot_value string, source_turn_id bigint, superseded_by_turn_id bigint"
    state_schema = "seq array<bigint>, texts array<string>, turns array<bigint>, keys array<string>, vals array<string>, status array<string>, by array<bigint>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ledger = Ledger(max_stale)
        if state.exists:
            for n, (seq, text, turn, slot, value, status, by) in enumerate(zip(*state.get, strict=True)):
                f = Fact(int(seq), text, int(turn), slot_key=slot, slot_value=value, status=status, superseded_by_turn_id=None if by is None or by < 0 else int(by))
                ledger.facts[n], ledger.by_text[f.norm] = f, n
                ledger.by_slot.setdefault(slot or "", []).append(n)
                ledger.stale.update({n} if status == "stale" else ())
            ledger.arrivals = len(ledger.facts)
        before = {f.text: f.status for f in ledger.rows()}
        for batch in batches:
            for r in batch.sort_values("seq", kind="stable").to_dict("records"):
                ledger.add(Fact(int(r["seq"]), r["text"], int(r["source_turn_id"]), slot_key=r["slot_key"], slot_value=r["slot_value"]))
        rows = ledger.rows()
        state.update(([f.seq for f in rows], [f.text for f in rows], [f.source_turn_id for f in rows], [f.slot_key for f in rows], [f.slot_value for f in rows], [f.status for f in rows], [-1 if f.superseded_by_turn_id is None else f.superseded_by_turn_id for f in rows]))
        changed = [(key[0], f.status, f.slot_key, f.slot_value, f.source_turn_id, f.superseded_by_turn_id) for f in rows if before.get(f.text) != f.status]
        if changed:
            yield pd.DataFrame(changed, columns=["namespace", "event", "slot_key", "slot_value", "source_turn_id", "superseded_by_turn_id"])

    return facts.groupBy("namespace").applyInPandasWithState(run, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events (ts, event_type) counted by time window, late ones up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
