from collections import Counter

import pytest

from corpusmill.llm import sharding
from tests.llm.tables import no_documents, odd_documents


def test_table_matches_the_statement_and_is_even(spark):
    names = sharding.shard_names(7)
    walks = sharding.preferences(spark, names, 211)
    owners = sharding.fill(walks, 211)
    assert owners == sharding.stated_owners(names, 211)
    counts = Counter(owners)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move_when_a_shard_goes(spark):
    names = sharding.shard_names(20)
    before = sharding.stated_owners(names, 4099)
    after = sharding.stated_owners(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.15 * len(before)


def test_place_on_odd_documents(spark):
    docs = odd_documents(spark)
    got = sharding.place(docs, "doc_id", sharding.shard_names(5))
    assert got.count() == docs.count()
    rows = got.collect()
    assert len({r.slot for r in rows if r.doc_id is None}) == 1
    assert all(0 <= r.shard < 5 for r in rows)
    assert "x.y" in got.columns and got.columns.count("slot") == 1
    assert sharding.place(no_documents(spark), "doc_id", sharding.shard_names(5)).count() == 0


def test_bad_tables_are_refused(spark):
    for names, slots in (([], 7), (["a", "b"], 2), (["a"], 9)):
        with pytest.raises(ValueError):
            sharding.lookup_table(spark, names, slots)
