import math
import re
import zlib
from collections import Counter

import pytest

from corpusmill.llm import quality
from corpusmill.storage import table
from tests.llm.tables import labels, no_documents, odd_documents


def stated(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def check(docs, marks):
    rows = quality.judge(docs, marks).collect()
    want = Counter((d.doc_id, stated(d.text)) for d in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept in (True, False) and not (r.kept and r.base_failed)
    return rows


def test_odd_documents(spark):
    check(odd_documents(spark), labels(spark))
    docs = odd_documents(spark)
    kept = quality.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns
    assert quality.judge(no_documents(spark), labels(spark)).count() == 0


def test_without_trusted_documents_the_base_rules_decide(spark):
    rows = check(odd_documents(spark), labels(spark, rows=[(8, 0, 1)]))
    assert all(r.kept == (not r.base_failed) for r in rows)


def test_statistics_and_verdicts_on_real_documents(spark):
    docs, marks = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in check(docs, marks)}
    good = [m.doc_id for m in marks.where("quality = 1 AND toxic = 0").collect() if not rows[m.doc_id].base_failed]
    assert sum(rows[d].kept for d in good) >= 0.98 * len(good)


def test_ratio_matches_the_formula():
    import numpy as np

    buckets = np.array([0, 0, 1])
    trusted, raw = np.array([4.0, 0.0, 6.0]), np.array([10.0, 5.0, 85.0])
    got, _ = quality.ratio(buckets, trusted, raw, 10, 100)
    rest = 97
    want = (2 * (math.log(4 + quality.PRIOR) - math.log(8 * 10 / rest + quality.PRIOR)) + (math.log(quality.PRIOR) - math.log(4 * 10 / rest + quality.PRIOR))) / 3
    assert abs(got - want) < 1e-12


MASK = (1 << 64) - 1


def stated_buckets(text):
    """The buckets of unigrams and bigrams, one word after another."""
    h = [zlib.crc32(w.encode().lower()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    odd, more = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
    pairs = [(a * odd & MASK) ^ (b * more & MASK) for a, b in zip(h, h[1:])]
    return [[(x * odd & MASK) >> (64 - quality.BUCKET_BITS) for x in xs] for xs in (h, [p ^ (p >> 29) for p in pairs])]


def stated_verdicts(docs, trusted):
    """kept and both ratios of each document (doc_id, text), by the definition: counts, thresholds and verdicts, with dictionaries."""
    grams = [stated_buckets(t) for _, t in docs]
    raw, target = ([Counter(), Counter()] for _ in range(2))
    for (d, _), g in zip(docs, grams):
        for order in (0, 1):
            raw[order].update(g[order])
            if d in trusted:
                target[order].update(g[order])
    n_raw, n_target = ([sum(c.values()) for c in x] for x in (raw, target))
    out = []
    for (d, text), g in zip(docs, grams):
        ratios = []
        for order in (0, 1):
            own, total = Counter(g[order]), 0.0
            mine = own if d in trusted else Counter()
            size = n_target[order] - sum(mine.values())
            for b, n in own.items():
                t, r = target[order][b] - mine[b], raw[order][b] - n
                total += n * (math.log(t + quality.PRIOR) - math.log(r * size / max(1, n_raw[order] - len(g[order])) + quality.PRIOR))
            ratios.append(total / len(g[order]) if g[order] and n_target[order] else 0.0)
        n_words, _, _, _, repeated = stated(text)
        out.append((d, ratios, n_words < 50 or 100 * repeated > 50 * n_words))
    least = []
    for order in (0, 1):
        bins = sorted(math.floor(r[order] * quality.STEPS) for d, r, failed in out if d in trusted and not failed)
        need = quality.QUANTILE * len(bins)
        least.append(next((b / quality.STEPS for i, b in enumerate(bins) if i + 1 >= need), -math.inf))
    return [(d, r, not failed and r[0] >= least[0] and r[1] >= least[1]) for d, r, failed in out], least


@pytest.mark.parametrize("most", [quality.MOST_TRUSTED, 0])
def test_counts_thresholds_and_verdicts_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "MOST_TRUSTED", most)  # with none, trusted ids are never broadcast
    docs, marks = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "word " * 60), (-3, "zq1 xv2 " * 5 + " ".join(f"qj{i}" for i in range(80)))], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra).unionByName(docs.select("doc_id", "text").limit(3))
    trusted = {m.doc_id for m in marks.where("quality = 1 AND toxic = 0").collect()}
    rows = [(d.doc_id, d.text) for d in docs.collect()]
    want, least = stated_verdicts(rows, trusted)
    got = quality.judge(docs, marks).collect()
    by = {}
    for d, r, kept in want:
        if all(abs(r[k] - least[k]) > 1e-9 for k in (0, 1)):
            by[d] = (r, kept)
    assert len(got) == len(rows) and len({k for _, _, k in want}) == 2
    for r in got:
        if r.doc_id in by:
            (one, two), kept = by[r.doc_id]
            assert abs(r.ratio_1 - one) < 1e-9 and abs(r.ratio_2 - two) < 1e-9 and r.kept == kept
    kept = Counter(r.doc_id for r in quality.keep_good(docs, marks).collect())
    assert kept == Counter(r.doc_id for r in got if r.kept)


def test_columns_with_any_name_stay_as_they_are(spark):
    docs = odd_documents(spark).selectExpr("*", "'a' AS q", "'b' AS q_", "'c' AS is_trusted", "'d' AS n_words", "'e' AS score_1")
    kept = quality.keep_good(docs, labels(spark)).collect()
    assert kept and all((r.q, r.q_, r.is_trusted, r.n_words, r.score_1) == ("a", "b", "c", "d", "e") for r in kept)
