import random
import re

import pytest
import xxhash

from corpusmill.llm import simhash
from tests.llm.tables import no_documents, odd_documents, prose


def stated(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """Smallest id reachable by brute force over all pairs."""
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def test_masks_meet_every_pair_within_the_radius():
    for i in range(64):
        for j in range(64):
            flip = (1 << i) | (1 << j)
            assert any(flip & m == 0 for m in simhash.MASKS)


def test_fingerprints_and_components_on_odd_documents(spark):
    docs = odd_documents(spark)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, stated(r.text)) for r in rows]
    part = components(want)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(d), f"{f:016x}", part[f]) for d, f in want)


def test_no_documents(spark):
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.keep_one(no_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_dense_spots_match_brute_force(spark, seed):
    rng = random.Random(seed)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps.add(centre)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    chain = rng.getrandbits(64)
    for k in range(20):
        chain ^= (1 << (3 * k % 64)) | (1 << ((3 * k + 1) % 64))
        fps.add(chain)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    want = components(rows)
    frame = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "doc_id long, fp long")
    got = {r.fp & (2**64 - 1): r.component for r in simhash.component_of(frame, "doc_id").collect()}
    assert got == want


def test_keep_one_keeps_all_columns_and_one_row_of_each_group(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert kept.count() == len(groups)
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(1) == 1


def test_long_text_is_read_whole():
    text = prose(300_000, 9)
    assert simhash.fingerprints([text])[0] == stated(text)


def test_columns_with_any_name_stay_as_they_are(spark):
    docs = odd_documents(spark).selectExpr("*", "'a' AS row", "'b' AS fp_", "'c' AS __cm_row")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and all((r["row"], r.fp_, r["__cm_row"], r.fp) == ("a", "b", "c", "fp") for r in kept.collect())
