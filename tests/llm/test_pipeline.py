import struct
import zlib
from collections import Counter

import corpus_pipeline
from corpusmill.llm import langid, mixing, packing, quality, simhash
from corpusmill.storage import materialize, table
from tests.llm.tables import no_documents

SF = "/root/testdata/sf0.001"


def test_stages_hold_what_their_operators_say(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, materialize(stage(spark, docs, SF), name))
        docs = seen[name][1]
        if name != "pack_sequences":
            assert docs.columns == columns
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in quality.judge(before, table(spark, SF, "labels")).where("kept").collect()}
    assert rows(after) == Counter({k: n for k, n in rows(before).items() if k[0] in kept})

    before, after = seen["language_id"]
    known = {r.doc_id for r in langid.identify(before).collect() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    assert rows(after) == Counter({k: n for k, n in rows(before).items() if k[0] in known})

    before, after = seen["near_dedup"]
    firsts = {r.component_id for r in simhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(firsts)

    before, after = seen["mix_sources"]
    often = Counter()
    for r in mixing.mix(before).collect():
        often[r.doc_id] += r.taken // r.size
    assert Counter(r.doc_id for r in after.collect()) == +often

    before, after = seen["pack_sequences"]
    words = packing.WordTokenizer(packing.default_tokenizer())
    want = Counter()
    for r, ids in zip(again := before.collect(), words.ids([r.text for r in again])):
        want[r.doc_id] += len(ids) // 4 + 1
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == want
    one = next(r for r in again if want[r.doc_id] <= 2048 and [x.doc_id for x in again].count(r.doc_id) == 1)
    pieces = sorted((p.start, p.length, p.ids_crc32) for p in after.collect() if p.doc_id == one.doc_id)
    ids = next(words.ids([one.text])) + struct.pack("<I", 1)
    assert [(s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for s, n, _ in pieces] == pieces


def test_an_empty_corpus_goes_through(spark):
    docs = no_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
