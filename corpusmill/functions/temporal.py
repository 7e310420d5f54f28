"""Predicates on dates, years and centuries in questions and texts, and the precise claims of an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import collapse, compatible

# The patterns that decide what counts as a date, a time and a figure.
MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
FULL_DATE = rf"\b(?:[0-3]?\d|primero)\s+de\s+(?:{MONTHS})(?:\s+de\s+\d{{3,4}})?\b|\b[0-3]?\d[/-][01]?\d[/-]\d{{2,4}}\b"
CENTURY = r"\bsiglo\s+[ivxlcdm]+\b"
EVIDENCE = rf"{FULL_DATE}|\b(?:1\d{{3}}|20\d{{2}})\b|{CENTURY}"
QUESTION = r"\b(cu[aá]ndo|fecha|qu[eé]\s+d[ií]a|en\s+qu[eé]\s+a[nñ]o|siglo)\b"
DATE_QUESTION = r"\b(fecha|qu[eé]\s+d[ií]a|d[ií]a\s+exacto)\b"
NUMBER = r"\b\d+(?:[.,]\d+)?\b"
RANGE = r"\b\d+(?:[.,]\d+)?\s*[-–—]\s*\d+(?:[.,]\d+)?\b"
PERCENT = r"\b\d+(?:[.,]\d+)?\s*%"
CLAIMS = [FULL_DATE, RANGE, PERCENT, CENTURY, NUMBER]
DATE_BONUS, TIME_BONUS = 0.012, 0.003

_FLAGS = "(?iuU)"


def found(text: Column, pattern: str) -> Column:
    return text.rlike(_FLAGS + f"(?:{pattern})")


def bonus(question: Column, evidence: Column) -> Column:
    """What a text with a date adds to its score if the question asks for a time."""
    return F.when(~found(question, QUESTION), 0.0).when(found(evidence, FULL_DATE), DATE_BONUS).when(found(evidence, EVIDENCE), TIME_BONUS).otherwise(0.0)


def claims(answer: Column) -> Column:
    """Dates, ranges, percentages, centuries and numbers in an answer without its [n] marks, kind after kind."""
    bare = F.regexp_replace(answer, r"\[\d+\]", "")
    return F.flatten(F.array(*(F.regexp_extract_all(bare, F.lit(f"{_FLAGS}(?:{p})"), F.lit(0)) for p in CLAIMS)))


def normalized(text: Column) -> Column:
    """For comparing claims with sources: compatible forms (NFKC), case folded, one kind of dash, no space before a per cent sign."""
    folded = F.replace(F.translate(F.lower(compatible(text)), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    return collapse(F.regexp_replace(F.regexp_replace(folded, "[–—]", "-"), r"(?U)\s*%", "%"))
