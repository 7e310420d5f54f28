import unicodedata
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import temporal, urls
from corpusmill.functions import text as T


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").withColumn("out", f(F.col("v"))).orderBy("i").collect()
    return [r.out for r in rows]


def test_collapse(spark):
    assert column(spark, ["  a \n\t b\u00a0c ", "", None], T.collapse) == ["a b c", "", None]


def test_fold_drops_marks_of_every_latin_letter(spark):
    text = "ÁÉÍÓÚ áéíóú ñÑ üÜ çÇ ßø ạ ấ"
    want = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    assert column(spark, [text, "a\u0301"], T.fold) == [want, "a"]


@pytest.mark.parametrize(("text", "slug"), [("Historia Universal I", "historia-universal-i"), ("  Biología: célula! ", "biologia-celula"), ("Straße", "strae"), ("---", ""), ("日本", "")])
def test_slug(spark, text, slug):
    assert column(spark, [text], T.slug) == [slug]


def test_query_tokens(spark):
    got = column(spark, ["¿Cuál fue la fecha de inicio de la Independencia de México?", "el 5 de mayo 5 MAYO", "de la", "a1 b2c " + " ".join(f"term{i}" for i in range(20))], T.query_tokens)
    assert got[:3] == [["inicio", "independencia", "mexico"], ["5", "mayo"], []]
    assert len(got[3]) == 12


def test_boilerplate_questions_and_errors(spark):
    assert column(spark, ["Menu", "cargando...", ".Leer mas.", "x", "Menú", "ok"], T.is_useful) == [False, False, False, False, True, True]
    assert column(spark, ["abc", " a ", "a" * 1001, "    ab   "], T.valid_question) == [True, False, False, False]
    assert column(spark, ["404 Not Found", "x 410 Gone y", "503"], T.permanently_missing) == [True, True, False]


BASE = "https://site.example/base"
HREFS = ["/a//b/", "c/d", "https://site.example/x?y=1#z", "http://site.example/", "//site.example/q", "https://other.example/x", "mailto:a@b", "/f.PDF", "/f.pdf/g", "../up", "./here", "?only=query", "", "a/../../b", "javascript:void(0)", "/á b"]


def test_canonical_matches_the_standard_library(spark):
    def stated(href):
        x = urlsplit(urljoin(BASE.rstrip("/") + "/", href))
        if x.scheme not in ("http", "https") or x.netloc != "site.example" or x.path.lower().endswith(tuple(urls.IGNORED_SUFFIXES)):
            return None
        return "https://site.example/" + "/".join(p for p in x.path.split("/") if p)

    assert column(spark, HREFS, lambda c: urls.canonical(F.lit(BASE), c)) == [stated(h) for h in HREFS]


def test_public_and_malformed(spark):
    args = ("site.example", "mirror.example", "/alumno/")
    links = ["https://site.example/alumno/a?x#y", "https://site.example/b?x", "https://site.example/alumno//c", "https://else.example/alumno/a"]
    assert column(spark, links, lambda c: urls.public(c, *args)) == ["https://mirror.example/alumno/a", links[1], "https://mirror.example/alumno//c", links[3]]
    assert column(spark, links, lambda c: urls.malformed(c, *args)) == [False, False, True, True]


def test_ancestors(spark):
    assert column(spark, ["https://s/a/b"], urls.ancestors)[0][-2:] == ["https://s/a", "https://s/a/b"]


def test_temporal(spark):
    asks = ["¿Cuándo fue?", "CUÁNDO", "en qué año", "la fecha", "siglos pasados", "recuando"]
    assert column(spark, asks, lambda c: temporal.found(c, temporal.QUESTION)) == [True, True, True, True, False, False]
    texts = ["16 de septiembre de 1810", "primero de mayo", "5/2/1917", "en 1821", "siglo XIX", "código 31810", "nada"]
    assert column(spark, texts, lambda c: temporal.found(c, temporal.FULL_DATE)) == [True, True, True, False, False, False, False]
    assert column(spark, texts, lambda c: temporal.found(c, temporal.EVIDENCE)) == [True, True, True, True, True, False, False]
    assert column(spark, texts, lambda c: temporal.bonus(F.lit("¿cuándo?"), c))[2:5] == [0.012, 0.003, 0.003]
    assert set(column(spark, texts, lambda c: temporal.bonus(F.lit("¿qué?"), c))) == {0.0}


def test_claims(spark):
    got = column(spark, ["El 5 de mayo de 1862 [1], 25 % de 10-20 en el siglo XIX"], temporal.claims)[0]
    assert got == ["5 de mayo de 1862", "10-20", "25 %", "siglo XIX", "5", "1862", "25", "10", "20"]
    assert column(spark, ["25  %  10–20\nA"], temporal.normalized) == ["25% 10-20 a"]
