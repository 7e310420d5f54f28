from collections import defaultdict

from corpusmill.llm import mixing
from corpusmill.storage import table
from tests.llm.tables import no_documents, odd_documents


def stated_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(docs):
    sources = {}
    for r in docs.select("doc_id", "source").collect():
        sources[r.doc_id] = r.source
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r, s in ((r, sources[r.doc_id]) for r in rows):
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = stated_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) <= 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    return {(r.doc_id, r.taken) for r in rows}


def test_targets_are_met(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert check(docs) == check(docs.repartition(5))


def test_odd_documents(spark):
    docs = odd_documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check(docs)
    docs = odd_documents(spark)
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mix(no_documents(spark)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.where("text IS NULL").count() == 0


def test_columns_with_any_name_stay_as_they_are(spark):
    docs = odd_documents(spark).selectExpr("*", "'a' AS row", "'b' AS often", "'c' AS copy", "'d' AS __cm_row", "'e' AS weight")
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns and all((r["row"], r.often, r.copy, r.weight) == ("a", "b", "c", "e") for r in rows.collect())
