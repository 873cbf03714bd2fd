"""The order-dependent ledger fold, as a Python state machine for grouped maps and streaming state.

Adding a fact: a fact with the same normalised text absorbs it (a strictly newer turn and its provenance are taken
over, an active arrival makes it active again). Otherwise, if it has a slot and a value: a value that is already stale
in its slot stays stale (re-extraction guard); else every active fact of the slot with another value loses to it if
that fact's turn is not later, or beats it. Last, the oldest stale facts beyond the cap are forgotten.

Facts are indexed by text and by slot, so an arrival costs what its slot holds, not the whole ledger; a matcher, which
may join any two slots, falls back to all facts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

MAX_STALE = 10


@dataclass(slots=True, eq=False)
class Fact:
    seq: int
    text: str
    source_turn_id: int
    kind: str = "entity"
    status: str = "active"
    slot_key: str | None = None
    slot_value: str | None = None
    subject: str | None = None
    attribute: str | None = None
    superseded_by_turn_id: int | None = None
    value: str | None = None
    is_correction: bool = False
    session_id: str | None = None
    ts: str | None = None
    modality: str | None = None

    @property
    def norm(self) -> str:
        return self.text.strip().lower()


@dataclass
class Ledger:
    """max_stale: how many stale facts are kept. same_slot: an identity test beyond equal keys."""

    max_stale: int = MAX_STALE
    same_slot: Callable[[Fact, Fact], bool] | None = None
    facts: dict[int, Fact] = field(default_factory=dict)
    by_text: dict[str, int] = field(default_factory=dict)
    by_slot: dict[str, list[int]] = field(default_factory=dict)
    stale: set[int] = field(default_factory=set)
    arrivals: int = 0

    def _slot_mates(self, fact: Fact) -> Iterable[Fact]:
        """Facts of the same slot, in the order of arrival."""
        if self.same_slot is None:
            return [self.facts[k] for k in self.by_slot.get(fact.slot_key or "", ()) if k in self.facts]
        return [f for f in self.facts.values() if (f.slot_key and f.slot_key == fact.slot_key) or self.same_slot(f, fact)]

    def _mark(self, number: int, fact: Fact, turn: int | None) -> None:
        fact.status, fact.superseded_by_turn_id = "stale", turn
        self.stale.add(number)

    def add(self, fact: Fact) -> None:
        known = self.by_text.get(fact.norm)
        if known is not None:
            self._absorb(known, fact)
            return
        number = self.arrivals
        self.arrivals += 1
        self._supersede(number, fact)
        self.facts[number] = fact
        self.by_text[fact.norm] = number
        if fact.slot_key:
            self.by_slot.setdefault(fact.slot_key, []).append(number)
        if fact.status == "stale":
            self.stale.add(number)
        self._forget()

    def _absorb(self, number: int, fact: Fact) -> None:
        own = self.facts[number]
        if fact.source_turn_id > own.source_turn_id:
            own.source_turn_id, own.session_id, own.ts = fact.source_turn_id, fact.session_id, fact.ts
        if fact.status == "active":
            own.status, own.superseded_by_turn_id = "active", None
            self.stale.discard(number)

    def _supersede(self, number: int, fact: Fact) -> None:
        if not fact.slot_key or not fact.slot_value:
            return
        mates = list(self._slot_mates(fact))
        for mate in mates:
            if mate.status == "stale" and mate.slot_value == fact.slot_value:
                winner = mate.superseded_by_turn_id
                if winner is None:
                    winner = next((m.source_turn_id for m in mates if m.status == "active" and m.slot_value != fact.slot_value), None)
                fact.status, fact.superseded_by_turn_id = "stale", winner
                return
        rivals = {id(m) for m in mates if m.status == "active" and m.slot_value != fact.slot_value}
        for k, mate in self.facts.items() if self.same_slot else ((k, self.facts[k]) for k in self.by_slot.get(fact.slot_key, ()) if k in self.facts):
            if id(mate) not in rivals:
                continue
            if mate.source_turn_id <= fact.source_turn_id:
                self._mark(k, mate, fact.source_turn_id)
            else:
                fact.status, fact.superseded_by_turn_id = "stale", mate.source_turn_id

    def _forget(self) -> None:
        over = len(self.stale) - self.max_stale
        for k in sorted(self.stale, key=lambda k: (self.facts[k].source_turn_id, k))[: max(over, 0)]:
            gone = self.facts.pop(k)
            self.stale.discard(k)
            self.by_text.pop(gone.norm, None)
            if gone.slot_key:
                self.by_slot[gone.slot_key].remove(k)

    def merge(self, facts: Iterable[Fact]) -> None:
        """Takes in another ledger's facts: equal texts, forgotten ones of this ledger included, absorb; others are added."""
        known = {f.norm: (k, f) for k, f in self.facts.items()}
        for fact in facts:
            if fact.norm in known:
                k, own = known[fact.norm]
                if k in self.facts and self.facts[k] is own:
                    self._absorb(k, fact)
            else:
                number = self.arrivals
                self.add(fact)
                known[fact.norm] = (number, fact)

    def rows(self) -> list[Fact]:
        return list(self.facts.values())
