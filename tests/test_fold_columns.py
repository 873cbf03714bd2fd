"""Facts of a group, column by column."""

import pyarrow as pa

from recollect.operators import ledger
from recollect.operators.fold import Fact


def test_facts_keep_their_nulls_and_types():
    facts = [Fact(3, "b", 2, slot_key="k", slot_value="v", is_correction=True), Fact(1, "a", 5, superseded_by_turn_id=7, status="stale"), Fact(2, "c", 2)]
    table = ledger._table("n", facts)
    assert table.schema.field("superseded_by_turn_id").type == pa.int64() and table.schema.field("is_correction").type == pa.bool_()
    back = ledger._facts(table, ["source_turn_id", "seq"])
    assert [f.seq for f in back] == [2, 3, 1]
    assert [(f.superseded_by_turn_id, f.is_correction, f.slot_key) for f in back] == [(None, False, None), (None, True, "k"), (7, False, None)]
    assert ledger._facts(ledger._table("n", []), ["seq"]) == [] and len(ledger._table("n", [])) == 0
