"""Column functions for texts: cleaning, folding, slugs, tokens and hashes.

They stay in the JVM. Spark has no Unicode normalisation, so tables made by rule stand for it; only texts with characters beyond
the tables (ligatures, fractions, Hangul) go through an Arrow UDF.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that a lexical query leaves out.
STOPWORDS = [
    "como", "cómo", "con", "cual", "cuál", "cuales", "cuáles", "cuando", "cuándo", "del", "donde", "dónde", "el", "ella", "en", "esta",
    "este", "fecha", "fue", "las", "los", "para", "por", "que", "qué", "quien", "quién", "segun", "según", "son", "una", "uno",
]
# Blocks that are never content. The mark after the first is stripped before the comparison, so it is stored without.
BOILERPLATE = ["cargando", "leer mas", "menu", "pasar al contenido principal"]
# Messages of errors that make a page count as skipped.
GONE = ["404 Not Found", "410 Gone"]

TOKEN = r"[\p{L}\p{N}]+"
SPELT = r"[\p{L}\p{N}\p{M}]+"
MOST_TERMS = 12
LEAST_TERM = 3
LEAST_QUESTION, MOST_QUESTION = 3, 1000


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to one base letter, and that letter."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()
_BASE = str.maketrans(ACCENTED, PLAIN)


def collapse(text: Column) -> Column:
    """Runs of white space, the no-break space included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """As the index folds: Latin letters by table, other scripts by dropping combining marks."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}+", "")


@lru_cache(maxsize=2)
def _folding(form: str, marks: bool) -> tuple[str, str, str]:
    """By rule, for a normalisation form: characters with a form of one character, their forms, and a class of all that need more.

    Without ``marks``, characters that are nothing but combining marks come last among the first, with no form: they are deleted.
    """
    one: list[str] = []
    to: list[str] = []
    none: list[str] = []
    more: list[int] = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if not (unicodedata.decomposition(c) or unicodedata.combining(c) or 0x1160 <= code < 0x1200 or 0xAC00 <= code < 0xD7A4):
            continue
        found = unicodedata.normalize(form, c)
        if not marks:
            found = "".join(x for x in found if not unicodedata.combining(x))
        if not found:
            none.append(c)
        elif len(found) > 1 or (marks and unicodedata.combining(c)) or (marks and unicodedata.category(c) == "Lo" and 0x1160 <= code < 0x1200):
            more.append(code)  # marks may join what stands before them
        elif found != c:
            one.append(c)
            to.append(found)
    return "".join(one + none), "".join(to), _ranges(more)


def _ranges(codes: list[int]) -> str:
    """Sorted code points as what stands in a character class."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


def _is_odd(text: Column, more: str) -> Column:
    """Whether a text has a character of the class ``more``. Texts of plain Latin letters are told by a short class, and the long one isn't tried."""
    member = re.compile(f"[{re.sub(r'.x{([0-9A-F]+)}', lambda m: chr(92) + 'U' + m[1].zfill(8), more)}]")
    plain = _ranges([code for code in range(0x250) if not member.match(chr(code))])
    return text.rlike(f"[^{plain}]") & text.rlike(f"[{more}]")


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def unaccented(text: Column) -> Column:
    """Compatibility decomposition (NFKD) of any script without combining marks."""
    chars, forms, more = _folding("NFKD", False)
    return F.coalesce(_decomposed(F.when(_is_odd(text, more), text)), F.translate(text, chars, forms))


def compatible(text: Column) -> Column:
    """Compatibility composition (NFKC)."""
    chars, forms, more = _folding("NFKC", True)
    return F.coalesce(_composed(F.when(_is_odd(text, more), text)), F.translate(text, chars, forms))


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, with single hyphens between; what has no ASCII form is dropped."""
    ascii_only = F.regexp_replace(unaccented(text), r"[^\x00-\x7F]+", "")
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def index_tokens(text: Column) -> Column:
    """Letters and digits in lower case without accents, with repeats."""
    return F.regexp_extract_all(fold(F.lower(text)), F.lit(TOKEN), F.lit(0))


def spelt_tokens(text: Column) -> Column:
    """The tokens of :func:`index_tokens` as they are spelt: with accents and marks. :func:`folded` makes those of them, or nothing of marks alone."""
    return F.regexp_extract_all(F.lower(text), F.lit(SPELT), F.lit(0))


def folded(token: str) -> str:
    """:func:`fold` for one token."""
    return token if token.isascii() else "".join(c for c in token.translate(_BASE) if unicodedata.category(c)[0] != "M")


def query_tokens(question: Column, most: int = MOST_TERMS) -> Column:
    """Distinct terms in order: three letters or a number, and no stop word; folded like the index."""
    words = F.regexp_extract_all(F.lower(question), F.lit(TOKEN), F.lit(0))
    kept = F.filter(words, lambda w: ((F.length(w) >= LEAST_TERM) | w.rlike("^[0-9]+$")) & ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(F.transform(kept, fold)), 1, most)


def is_useful(block: Column, boilerplate: list[str] | None = None) -> Column:
    """Two characters or more, and not boilerplate."""
    core = F.lower(F.regexp_replace(block, "^[ .]+|[ .]+$", ""))
    return (F.length(block) >= 2) & ~core.isin(boilerplate or BOILERPLATE)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def excerpt(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(text, 1, n)


def valid_question(question: Column) -> Column:
    """Of 3 to 1000 characters, and of 3 or more once white space is collapsed."""
    return F.length(question).between(LEAST_QUESTION, MOST_QUESTION) & (F.length(collapse(question)) >= LEAST_QUESTION)


def permanently_missing(message: Column) -> Column:
    out = F.lit(False)
    for m in GONE:
        out = out | message.contains(m)
    return out


def embedding_text(title: Column, subject: Column, heading: Column, text: Column) -> Column:
    """What is handed to the embedding model. The labels are fixed values, as vectors depend on them."""
    return F.concat(F.lit("Asignatura: "), subject, F.lit("\nRecurso: "), title, F.lit("\nSeccion: "), heading, F.lit("\n"), text)
