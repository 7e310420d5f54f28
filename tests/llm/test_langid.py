import math
import zlib

from corpusmill.llm import langid
from corpusmill.storage import table
from tests.llm.tables import no_documents, odd_documents


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for k in (4, 5, 6, 11):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert langid.identify(no_documents(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and 5 not in [r.doc_id for r in kept.collect()]


def test_lang_of_held_out_rows_is_not_used(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    other = docs.withColumn("lang", langid.F.when(langid.held_out(), "xx").otherwise(langid.F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).collect()} for d in (docs, other))
    assert a == b


UNLEARNED = {
    "pl": "Wczoraj wieczorem poszliśmy nad rzekę, żeby zobaczyć, jak słońce zachodzi za wzgórzami. Moja siostra przyniosła chleb, ser i kilka jabłek z ogrodu. ",
    "fi": "Eilen illalla kävelimme joen rantaan katsomaan auringonlaskua. Sisareni toi mukanaan leipää, juustoa ja omenoita puutarhasta. ",
    "nl": "Gisteravond liepen we naar de rivier om te zien hoe de zon achter de heuvels verdween. Mijn zus had brood en kaas meegenomen. ",
    "it": "Ieri sera siamo andati al fiume per vedere il sole tramontare dietro le colline. Mia sorella ha portato pane e formaggio. ",
    "ru": "Вчера вечером мы пошли к реке посмотреть, как солнце садится за холмами. Сестра принесла хлеб, сыр и яблоки. ",
    "gibberish": "qzx vkjw pfrt xxgh bnmq wrtz kljh zxcv qwrt plkj mnbv ghjk tyui vbnm qazw sxed crfv tgby yhnu jmik ",
}


def test_text_in_no_learned_language_is_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("n_chars >= 300").select("doc_id", "text", "lang")
    clean = docs.where(langid.held_out()).collect()
    halves = [" ".join(r.text[:400] for r in clean if r.lang == "en")[:4000] + UNLEARNED["pl"] * 30]
    odd = [(-1 - i, text, None) for i, text in enumerate([t * 5 for t in UNLEARNED.values()] + halves)]
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(spark.createDataFrame(odd, docs.schema))).collect()}
    assert not [i for i, _, _ in odd if i in kept]
    assert sum(r.doc_id in kept for r in clean) >= 0.99 * len(clean)
    assert {r.lang for r in clean if r.doc_id in kept} == {"de", "en", "es", "fr"}


def test_each_document_is_fitted_with_its_own_label(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "Model", lambda x, langs: seen.update(x=x, langs=langs))
    texts = {"de": "der fluss", "en": "the river", "fr": "la rive"}
    langid.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string"))
    for x, lang in zip(seen["x"], seen["langs"]):
        assert abs(x - langid.features(texts[lang])).max() < 0.001


def test_votes_match_brute_force():
    """Every machine's margin is computed on its own, one multiplication after another, and votes are counted by hand."""
    import numpy as np

    texts = {"en": "the house of the river and the people", "de": "das haus und der fluss und die leute", "nl": "het huis en de rivier en de mensen van", "es": "la casa y el rio de la gente", "fr": "la maison et la riviere des gens"}
    rows = [(lang, f"{t} {t[::2]} {k}" + " x" * (k % 3)) for lang, t in texts.items() for k in range(20)]
    x = np.stack([langid.features(t) for _, t in rows])
    assert np.array_equal(x, x.astype(np.float16).astype(np.float32))  # fitted and predicted in one precision
    langs = np.array([lang for lang, _ in rows], dtype=object)
    model = langid.Model(x, langs)

    def stated_vote(vote, v):
        if len(vote.classes) == 1:
            return vote.classes[0], 1.0
        margins = {}
        for (a, b), w, scale in zip(vote.pairs, vote.weights, vote.scales):
            margins[a, b] = scale * (sum(float(p) * float(q) for p, q in zip(w, v)) + w[-1])
        votes = [sum(m >= 0 if a == k else m < 0 for (a, b), m in margins.items() if k in (a, b)) for k in range(len(vote.classes))]
        sums = [sum(m if a == k else -m for (a, b), m in margins.items() if k in (a, b)) for k in range(len(vote.classes))]
        best = sorted(range(len(votes)), key=lambda k: (-votes[k], -sums[k], k))[0]
        worst = min(m if a == best else -m for (a, b), m in margins.items() if best in (a, b))
        return vote.classes[best], 1 / (1 + math.exp(-worst))

    assert model.families.classes == ["germanic", "romance"] and model.within["germanic"].classes == ["de", "en", "nl"]
    for _, text in rows[::7] + [("", "der and la casa"), ("", "people leute"), ("", "xyz")]:
        v = langid.features(text)
        family, sure = stated_vote(model.families, v)
        lang, also = stated_vote(model.within[family], v)
        logs, least = model.likeness[lang]
        known = sum(float(p) * float(q) ** 2 for p, q in zip(logs, v)) >= least
        got, score = model(text)
        assert got == lang and abs(score - sure * also * (1 if known else langid.LEAST_SCORE / 2)) < 1e-6


def test_null_ids_are_hashed_with_the_rest(spark):
    docs = odd_documents(spark).selectExpr("*", "'a' AS p", "'b' AS p_")
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and all((r.p, r.p_) == ("a", "b") for r in kept.collect())
