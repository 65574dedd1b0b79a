"""Language identification by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary of labelled texts. A text is cut into pieces of ``PIECE`` bytes, so that
the dictionary and not the text's own history decides however long it is; all pieces count, in lower case. The language of the
smallest total size wins; the margin to the second, as a share of the second's size, is the score, and texts under
``MIN_MARGIN`` are rejected.

The dictionaries are fitted on a bounded sample of the labelled rows: for each language and each of ``SAMPLE`` hash buckets
the text of smallest hash, and of it ``SAMPLE_CHARS`` characters around its middle. ``DICTIONARY`` bytes a language are kept.

Contract of ``identify``:
* only text and label of the training rows are learned from; a prediction reads the text alone;
* a null text, or one without a letter, is ``und`` with score 0 and rejected; without any learned language so are all;
  with a single one every other text gets it, with score 1;
* ties go to the language that comes first in code point order; repeated rows and null ids are kept; an empty table gives an
  empty result; extra columns are kept by both, but for ``identify``'s own three names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbalest.llm.common import free_name, in_small_batches

SAMPLE, SAMPLE_CHARS, DICTIONARY = 256, 2048, 1 << 16
#: Languages at most: the sample on the driver stays under 512 MB, the dictionaries under 64 MB.
LANGUAGES = 1000
PIECE, LEVEL = 4096, 9
MIN_MARGIN = 0.005
UND = "und"


def fit(training: DataFrame, label: str = "lang", sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, dictionary) in code point order, from a bounded sample; an error beyond ``LANGUAGES`` of them."""
    if training.where(F.col(label).isNotNull()).select(label).distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in {label!r}: their dictionaries are sent to every task")
    rows = training.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("lang"), "text")
    rows = rows.withColumn("h", F.xxhash64("text"))
    picks = rows.groupBy("lang", F.pmod("h", F.lit(sample)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")  # at most ``sample`` a language
    middle = F.substring("text", F.greatest(F.lit(1), F.expr(f"int(length(text) / 2) - {SAMPLE_CHARS // 2}")), F.lit(SAMPLE_CHARS))
    texts = rows.join(F.broadcast(picks), ["lang", "h"]).select("lang", "h", middle.alias("text")).dropDuplicates(["lang", "h"])
    found = texts.toPandas().sort_values(["lang", "h"])
    return [(lang, "\n".join(part.text).lower().encode()[:DICTIONARY]) for lang, part in sorted(found.groupby("lang"), key=lambda x: x[0].encode())]


def sizes(text: bytes, coders: list[zstandard.ZstdCompressor], piece: int = PIECE) -> list[int]:
    pieces = [text[i : i + piece] for i in range(0, len(text), piece)]
    return [sum(len(c.compress(p)) for p in pieces) for c in coders]


def predictor(languages: list[tuple[str, bytes]], level: int = LEVEL):
    """A function of (text, has a letter) giving lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        coders = []
        for _, content in languages:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False))
        names = [name for name, _ in languages]

        def one(text: str | None, letter: bool) -> tuple[str, float]:
            if not letter or not coders:
                return UND, 0.0
            if len(coders) == 1:
                return names[0], 1.0
            got = np.array(sizes(text.lower().encode(), coders))
            first, second = np.argsort(got, kind="stable")[:2]
            return names[first], float((got[second] - got[first]) / got[second])

        for texts, letters in batches:
            yield pd.DataFrame([one(t, x) for t, x in zip(texts, letters)], columns=["lang_pred", "score"])

    return predict


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, languages: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced."""
    docs, found = in_small_batches(docs), free_name(docs, "found")
    docs = docs.drop("lang_pred", "score", "rejected").withColumn(found, predictor(languages)(F.col("text"), has_letter(F.col("text"))))
    p = F.col(found)
    return docs.withColumns({"lang_pred": p["lang_pred"], "score": p["score"], "rejected": (p["lang_pred"] == UND) | (p["score"] < min_margin)}).drop(found)


def keep_identified(docs: DataFrame, languages: list[tuple[str, bytes]], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is found with enough margin, with their columns alone."""
    flagged = identify(docs.select(F.struct("*").alias("_row"), "text"), languages, min_margin)
    return flagged.where("not rejected").select("_row.*")
