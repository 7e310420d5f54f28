import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import lm
from corpusmill.storage import table
from tests.llm.tables import no_documents, odd_documents


def words(text):
    return [re.sub(b"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [b""]


def part(doc_id):
    if doc_id is None:
        return 1
    crc = zlib.crc32(str(doc_id).encode())
    return 0 if crc % 7 == 2 else 1 + crc // 7 % 2


class Stated:
    """The whole model by plain counting."""

    def __init__(self, rows):
        self.uni, self.bi, self.starts = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
        for d, text in rows:
            if p := part(d):
                w = words(text)
                self.uni[p - 1].update(w)
                self.bi[p - 1].update(zip([None, *w], w))
                self.starts[p - 1] += 1
        self.v = len(self.uni[0].keys() | self.uni[1].keys())
        cells = Counter()
        for own, other in ((0, 1), (1, 0)):
            for (u, w), n in self.bi[own].items():
                context, p1, p2 = self.estimates(self.uni[other], self.bi[other], self.starts[other], u, w)
                step = lambda p: int(lm._step(np.array([p * (self.v + 1)]))[0])
                code = (int(lm.context_bucket(np.array([context]))[0]) * (2 * lm.REACH + 1) + step(p1) + lm.REACH) * (2 * lm.REACH + 1) + step(p2) + lm.REACH
                cells[code] += n
        self.weights = lm.learn_weights(cells)
        self.all, self.pairs = self.uni[0] + self.uni[1], self.bi[0] + self.bi[1]
        self.n = sum(self.all.values())

    @staticmethod
    def estimates(uni, bi, starts, u, w):
        context = starts if u is None else uni[u]
        return context, uni[w] / max(1, sum(uni.values())), bi[(u, w)] / max(1, context)

    def score(self, text):
        w, total = words(text), 0.0
        for pair in zip([None, *w], w):
            context, p1, p2 = self.estimates(self.all, self.pairs, sum(self.starts), *pair)
            a = self.weights[int(lm.context_bucket(np.array([context]))[0])]
            total += math.log10(a[0] / (self.v + 1) + a[1] * p1 + a[2] * p2)
        return total

    def base(self, text):
        return sum(math.log10((self.all[x] + 1) / (self.n + self.v + 1)) for x in words(text))


def check(docs, rows):
    model = Stated(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    want = [(d, part(d) == 0, len(w := words(t)), sum(model.all[x] > 0 for x in w), model.n, model.base(t), model.score(t)) for d, t in rows]
    got = sorted(lm.lm_scores(docs).collect(), key=order)
    assert len(got) == len(want)
    for r, x in zip(got, sorted(want, key=order)):
        assert tuple(r)[:5] == x[:5]
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(tuple(r)[5:], x[5:]))
    return got


def test_small_documents_match_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 100)
    rows = [(i, " ".join("abcdefgh"[(i * i * 3 + k * (i % 5 + 1)) % 8] for k in range(i % 13))) for i in range(60)] + [(None, "a b c"), (None, None), (3, "a A a"), (3, "a A a")]
    check(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, tokens string, part int"), rows)


@pytest.mark.parametrize("fan", [2, 3])
def test_counts_in_several_levels_match_plain_counting(spark, monkeypatch, fan):
    monkeypatch.setattr(lm, "FAN", fan)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 30)
    rows = [(i, "the " * (i % 4) + " ".join("abcdefghijkl"[(i * i * 3 + k * (i % 5 + 1)) % 12] for k in range(i % 13))) for i in range(80)] + [(None, "the b c"), (None, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), rows)


def test_finer_buckets_lie_in_coarse_ones():
    rng = np.random.default_rng(1)
    words, keys = (np.sort(rng.integers(0, 2**n, 500, dtype=np.uint64)) for n in (64, 45))
    for buckets, share in ((1, 7), (5, 3), (12, 16)):
        fine = list(lm.cuts(words, keys, 45, buckets * share))
        for i, w, k, own in lm.cuts(words, keys, 45, buckets):
            inside = [x for x in fine if x[0] // share == i]
            assert (inside[0][1].start, inside[-1][1].stop, inside[0][2].start, inside[-1][2].stop) == (w.start, w.stop, k.start, k.stop)
            assert (own + lm._begin(i, buckets, 45) == keys[k]).all()
        assert sum(len(x[3]) for x in fine) == len(keys)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert lm.lm_scores(no_documents(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if part(i) == 0)
    (r,) = lm.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert r.score == 0.0


def test_held_out_text_is_more_likely_than_by_the_base(spark):
    rows = [r for r in lm.lm_scores(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_em_finds_the_weights_of_a_mixture():
    cells = {(5 * (2 * lm.REACH + 1) + 8 + lm.REACH) * (2 * lm.REACH + 1) + 40 + lm.REACH: 900, (5 * (2 * lm.REACH + 1) + 8 + lm.REACH) * (2 * lm.REACH + 1): 100}
    w = lm.learn_weights(cells)[5]
    assert abs(w.sum() - 1) < 1e-9 and w[2] > 0.85 and w[1] > w[0]
