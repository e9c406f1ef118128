"""Language identification by compression with per-language dictionaries.

Every learned language has a raw-content zstandard dictionary. A text is reduced to its letters
in lower case with single spaces for all else and cut into blocks; each block is compressed with each dictionary, and the language with the smallest sum of
sizes is predicted. A prediction whose margin over the second is narrow is marked as rejected.

Dictionaries are made from a bounded sample: at most ``PASSAGES`` passages of ``PASSAGE`` characters
per language, one from a place chosen by hash in each of the sampled documents, fewer where all languages
together would have over ``ALL_PASSAGES``, but one each. Every language is learned, and every block of every text is compressed
with all of them, ``LOADED`` dictionaries at a time.

Defined results: training texts without a letter teach nothing; ``held_out`` is null without ``doc_id``; a null text and one without a letter are ``und`` with score 0, and so is every
text if no language was learned; equal sizes go to the language that is most frequent in
the training rows, with a score of at most one half; rows are judged one by one even if they repeat a ``doc_id``; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.tables import parts

#: Training passages of a language at most, and of all languages together as long as each has one.
PASSAGES, ALL_PASSAGES = 96, 24_576
PASSAGE = 1024
LEVEL = 6

#: Bytes of text that are compressed at a time.
BLOCK = 4096

#: Dictionaries that are loaded at a time.
LOADED = 64

_NOT_LETTERS = re.compile(r"[\W\d_]+")

#: A margin below this share of the smallest size is narrow.
NARROW = 0.01


def training_passages(documents: DataFrame) -> list[tuple[str, str]]:
    """``(lang, passage)`` of the bounded sample, the most frequent language first."""
    rows = documents.where("lang IS NOT NULL").where(has_letter(F.col("text")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, min(PASSAGES, ALL_PASSAGES // max(1, counts.count())))
    # about four times as many as needed pass the hash, of which a rank takes the first
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - PASSAGE + 1))
    here = F.substring("text", place, F.lit(PASSAGE))
    first_letter = F.substring("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(PASSAGE))
    passages = (
        rows.select("doc_id", "lang", "text")
        .join(counts, "lang")
        .where(drawn * F.col("n") < 4 * each)
        .select(
            "lang",
            "n",
            F.xxhash64("doc_id", F.lit(2)).alias("turn"),
            F.when(has_letter(here), here).otherwise(first_letter).alias("passage"),
        )
        .dropDuplicates(["lang", "passage"])
    )
    ranked = passages.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY turn, passage) AS rank")
    found = ranked.where(F.col("rank") <= each).collect()
    order = sorted(found, key=lambda r: (-r["n"], r["lang"], r["rank"]))
    return [(r["lang"], r["passage"]) for r in order]


def letters_of(text: str) -> bytes:
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode()


def dictionaries(passages: list[tuple[str, str]]) -> tuple[tuple[str, bytes], ...]:
    """The languages in the order of ``passages``, each with its dictionary's content."""
    content: dict[str, list[bytes]] = {}
    for lang, passage in passages:
        content.setdefault(lang, []).append(letters_of(passage))
    return tuple((lang, b"".join(parts)) for lang, parts in content.items())


@lru_cache(2)
def _compressors(content: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, data in content:
        learned = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tuned = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=BLOCK, dict_size=len(data), write_content_size=False
        )
        learned.precompute_compress(compression_params=tuned)
        out.append(zstandard.ZstdCompressor(compression_params=tuned, dict_data=learned))
    return out


def sizes(texts: list[bytes], content: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """Compressed size of each text (rows) with each dictionary (columns)."""
    blocks = [[text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] for text in texts]
    out = np.zeros((len(texts), len(content)), np.int64)
    for at in range(0, len(content), LOADED):
        loaded = _compressors(content[at : at + LOADED])
        for row, own in enumerate(blocks):
            for column, c in enumerate(loaded, start=at):
                out[row, column] = sum(len(c.compress(b)) for b in own)
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def predicted(documents: DataFrame, content: tuple[tuple[str, bytes], ...]) -> DataFrame:
    """Per document ``doc_id, lang_pred, score, margin, rejected``."""
    names = [lang for lang, _ in content]
    kind = dict(documents.dtypes)["doc_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            langs, scores, margins = [], [], []
            letters = [known and bool(names) for known in batch.column("letters").to_pylist()]
            texts = batch.column("text").to_pylist()
            measured = iter(sizes([letters_of(t) for t, known in zip(texts, letters, strict=True) if known], content))
            for known in letters:
                if not known:
                    found, score, margin = "und", 0.0, 0.0
                else:
                    size = next(measured)
                    best = int(size.argmin())
                    score = float(1 / np.exp2(np.maximum(-1000.0, size[best] - size)).sum())
                    second = np.delete(size, best).min(initial=2 * size[best])
                    found, margin = names[best], float((second - size[best]) / size[best])
                langs.append(found)
                scores.append(score)
                margins.append(margin)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(margins, pa.float64()),
                    pa.array([m < NARROW for m in margins], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    rows = documents.select("doc_id", "text", has_letter(F.col("text")).alias("letters"))
    schema = f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean"
    return rows.mapInArrow(judge, schema)
