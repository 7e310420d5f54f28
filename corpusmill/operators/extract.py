"""From the items of a page to sections, texts and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusmill.session import ship
from corpusmill.sources.markup import NO_TEXT

LEAST_SECTION = 40
MAX_CHARS, OVERLAP = 1200, 150
CHUNK = StructType([StructField("ordinal", IntegerType()), StructField("heading", StringType()), StructField("text", StringType())])

_SECTIONS = """
filter(
  aggregate(items, named_struct('heading', {title}, 'blocks', CAST(array() AS array<string>), 'done', CAST(array() AS array<struct<heading: string, blocks: array<string>>>)),
    (s, x) -> CASE
      WHEN x.kind = 'h' AND x.text <> s.heading
        THEN named_struct('heading', x.text, 'blocks', CAST(array() AS array<string>), 'done', array_append(s.done, named_struct('heading', s.heading, 'blocks', array_distinct(s.blocks))))
      WHEN x.kind = 'h' THEN s
      ELSE named_struct('heading', s.heading, 'blocks', array_append(s.blocks, x.text), 'done', s.done) END,
    s -> array_append(s.done, named_struct('heading', s.heading, 'blocks', array_distinct(s.blocks)))),
  s -> length(array_join(s.blocks, ' ')) >= {least})
"""


def sectionise(read: DataFrame, title: str = "title", least: int = LEAST_SECTION) -> DataFrame:
    """Read pages (items, title) with sections, an array of struct<heading, blocks>, and the error if there are none.

    A heading that differs from the one before begins a section; blocks of a section are distinct; short sections go.
    The fold stays within a row, so nothing is shuffled.
    """
    out = read.withColumn("sections", F.expr(_SECTIONS.format(title=title, least=least)))
    return out.withColumn("error", F.coalesce("error", F.when(F.size("sections") == 0, F.lit(NO_TEXT))))


def document_text(sections: Column, title: Column) -> Column:
    """Headings, unless empty or the title itself, and blocks, with blank lines between."""
    parts = F.transform(sections, lambda s: F.concat(F.when((s["heading"] != "") & (s["heading"] != title), F.array(s["heading"])).otherwise(F.array().cast("array<string>")), s["blocks"]))
    return F.array_join(F.flatten(parts), "\n\n")


def cut_block(block: str, most: int = MAX_CHARS) -> list[str]:
    """Pieces of a long block: up to a sentence's end, else a space, in the second half; else ``most`` + 1 characters.

    One pass over the text by places in it. A fold of built-in functions would copy or walk what is left for every piece, which is
    quadratic in a long text.
    """
    out, at, end = [], 0, len(block)
    while end - at > most:
        cut = next((k for sep in (". ", " ") if (k := block.rfind(sep, at, at + most)) >= at + most // 2), at + most)
        out.append(block[at : cut + 1].strip())
        at = cut + 1
        while at < end and block[at].isspace():
            at += 1
        while end > at and block[end - 1].isspace():
            end -= 1
    return out + [block[at:end]] if at < end or not out else out


def tail_of(text: str, overlap: int) -> str:
    """The end of a chunk that the next one repeats, from the start of a word."""
    tail = text[-overlap:].lstrip() if overlap else ""
    return tail.partition(" ")[2] if len(text) > overlap and " " in tail else tail


def chunks_of(sections: list, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str, str]]:
    """(ordinal, heading, text) of a document's sections (heading, blocks).

    Blocks are joined while they fit; a full chunk's tail opens the next one of its section. The tail isn't counted against the
    first block after it, so a chunk can be longer than ``most``.
    """
    out: list[tuple[int, str, str]] = []
    for heading, blocks in sections:
        held: list[str] = []
        size = 0
        for piece in (p for b in blocks for p in cut_block(b, most)):
            if held and size + len(piece) + 2 > most:
                out.append((len(out), heading, "\n\n".join(held).strip()))
                tail = tail_of(out[-1][2], overlap)
                held, size = ([tail], len(tail)) if tail and tail != piece else ([], 0)
            size += len(piece) + (2 if held else 0)
            held.append(piece)
        if held:
            out.append((len(out), heading, "\n\n".join(held).strip()))
    return out


def chunk_documents(docs: DataFrame, key: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, heading, text): the chunks of documents (key, sections). Ordinals run through a document."""
    ship(docs.sparkSession)

    @F.pandas_udf(ArrayType(CHUNK))
    def chunked(sections: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("ordinal", "heading", "text"), c)) for c in chunks_of([(x["heading"], list(x["blocks"])) for x in s], most, overlap)] if s is not None else [] for s in sections])

    return docs.select(key, F.inline(chunked("sections")))


def split_blocks(blocks: DataFrame, column: str, most: int = MAX_CHARS) -> DataFrame:
    """``blocks`` with a row for each piece of ``column``, and its place in ``piece_no``."""
    ship(blocks.sparkSession)

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_block(t or "", most) for t in texts])

    return blocks.select(*[c for c in blocks.columns if c != column], F.posexplode(pieces(column)).alias("piece_no", column))
