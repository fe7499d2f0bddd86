"""Language by compression: the language whose zstandard dictionary makes a text smallest.

A language's dictionary is raw content: sentences from a bounded sample of its documents. A text is cut into
blocks, so that the dictionary counts everywhere and not at the start only, and each block is compressed with
each dictionary. The sizes are added up over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burnish.llm.common import held_out, lean
from burnish.operators.columns import col

UNDETERMINED = "und"
SAMPLE_DOCUMENTS = 400  # learned from, for each language; about so many are drawn by a hash of their id
SENTENCES, LONGEST = 6, 400  # from each of them, and characters of each
DICTIONARY_BYTES = 64 * 1024
MOST_LANGUAGES = 256  # more distinct values are an error: their dictionaries go to every task
BLOCK = 4096
LEVEL = 6
NARROW = 0.003  # reject if the second language's size is larger by less than this share
SENTENCE = re.compile(r"[^.\n]+")
LETTER = re.compile(r"[^\W\d_]")


@lean
def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for lang, draw, text in zip(batch["lang"], batch["draw"], batch["text"], strict=True):
            parts = [p for p in (s.strip().lower()[:LONGEST] for s in SENTENCE.findall(text)) if LETTER.search(p)]
            for i in np.unique(np.linspace(0, len(parts) - 1, min(SENTENCES, len(parts))).astype(int)) if parts else []:
                found.append((lang, draw, int(i), parts[i]))
        yield pd.DataFrame(found, columns=["lang", "draw", "nth", "sentence"])


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The dictionaries of all values of ``lang`` in ``docs(doc_id, text, lang)``, those with most rows first.

    Rows that are held out, or without a language or text, are not learned from. Collected are at most
    MOST_LANGUAGES * SAMPLE_DOCUMENTS * SENTENCES sentences of LONGEST characters.
    """
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    unit = float(1 << 31)
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, SAMPLE_DOCUMENTS / r.n * unit)])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 31))
    drawn = known.select("lang", "text", draw.alias("draw")).where(F.col("draw") < F.element_at(rates, F.col("lang")))
    sentences = drawn.mapInPandas(_sentences, "lang string, draw long, nth int, sentence string")
    first = Window.partitionBy("lang").orderBy("draw", "nth", "sentence")
    sentences = sentences.distinct().withColumn("at", F.row_number().over(first)).where(F.col("at") <= SAMPLE_DOCUMENTS * SENTENCES)
    texts: dict[str, list[bytes]] = {r.lang: [] for r in counts}
    for row in sentences.orderBy("lang", "at").collect():
        texts[row.lang].append(row.sentence.encode())
    return {lang: b"\n".join(parts)[:DICTIONARY_BYTES] for lang, parts in texts.items() if parts}


def compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries.values():
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=BLOCK, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=options)
        made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=options))
    return made


def sizes(text: str, encoders: list[zstandard.ZstdCompressor]) -> np.ndarray:
    data = text.lower().encode()
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    return np.array([sum(len(e.compress(block)) for block in blocks) for e in encoders], dtype=np.int64)


def _predict(dictionaries: dict[str, bytes], narrow: float):
    names = list(dictionaries)

    @lean
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = compressors(dictionaries)
        for texts in batches:
            found = []
            for text in texts:
                if not names or text is None or not LETTER.search(text):
                    found.append((UNDETERMINED, 0.0, True))
                    continue
                by = sizes(text, encoders)
                best = int(by.argmin())  # ties: the language with more rows
                behind = np.sort(np.delete(by, best) - by[best])
                odds = np.exp(-behind / (2 + 0.01 * by[best])).sum()
                rejected = bool(len(behind)) and behind[0] < max(1, narrow * (by[best] + behind[0]))
                found.append((names[best], 1 / (1 + odds), rejected))
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    return F.pandas_udf(
        predict,
        T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]),
    )


def prediction(docs: DataFrame, text: str = "text", narrow: float = NARROW):
    """A column (lang_pred, score, rejected) for the texts of ``docs``, learned from ``docs`` itself.

    Only the text is looked at. Texts that are null or have no letter are "und" with score 0 and rejected, and
    so is every text if no row can be learned from. ``rejected`` marks margins under ``narrow`` and ties.
    """
    return _predict(learn(docs), narrow)(F.col(text))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs(doc_id, text, lang, ...)``.

    Rows that repeat an id or have none each get a row; held_out is false without an id.
    """
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), prediction(docs).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told by a clear margin, all columns as they are."""
    row = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), "text", "doc_id", "lang")
    told = row.select("row", prediction(docs).alias("p"))
    return told.where(~F.col("p.rejected")).select("row.*")
