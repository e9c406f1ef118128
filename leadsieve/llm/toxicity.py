"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens score their log-odds between toxic and clean labelled documents with an informative
Dirichlet prior (the pooled token shares), less a drift, so that ordinary text scores below
zero. A token without a score of its own backs off to its longest prefix that has one, so
unseen forms of a known stem count. A linear scan finds all maximal segments. For clean text the best score follows an
extreme-value distribution: its decay solves the moment equation of the clean token scores, its
scale is fitted to the clean documents. A document's evidence is what its significant
segments exceed that distribution by, and a logistic curve turns it into a probability.

The model is fitted on a bounded sample: ``SAMPLE`` labelled documents of each class, chosen by a
hash of the id, and at most ``TERMS`` tokens, the most significant ones. Scoring reads every token
of every text.

Defined results: null and empty texts have no tokens and score what a document without toxic passages
does; a stretch that adds nothing to a passage is left out of it, so passages begin and end with tokens that
count for them; ``held_out`` is null without ``doc_id``; without labels of both classes every score is 0; rows with several labels count as
toxic if one of them is; rows are scored one by one even if they repeat a ``doc_id``; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.tables import checkpointed, lean, lowered, parts, slices

#: Labelled documents of each class that a model is fitted on, about.
SAMPLE = 4_000

#: Tokens that a model scores by name.
TERMS = 50_000

#: Documents of the sample that a token must be in.
MIN_DOCS = 5

#: Signed root of the likelihood ratio that a token's share of documents must reach.
SIGNIFICANT = 4.0

#: Lengths in bytes of the prefixes that tokens back off to, the longest first.
PREFIXES = (9, 8, 7, 6, 5, 4)

#: Token scores that a task remembers at a time.
REMEMBERED = 100_000

#: Occurrences that the prior counts as.
PRIOR = 100.0

DRIFT = 1.0

#: Expected number of chance segments below which a segment is significant.
EXPECTED = 0.05

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    """What scoring needs; prefixes are scored under their bytes with a leading ``^``."""

    scores: dict[bytes, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    intercept: float = -np.inf

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if np.isneginf(self.intercept):
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -700, 700)))


def segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in order, in linear time."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    found: list[tuple[float, float, int, int, int]] = []  # low, high, start, end, last one below
    up = np.flatnonzero(values > 0)
    if not len(up):
        return []
    breaks = np.flatnonzero(np.diff(up) > 1)
    starts = up[np.concatenate(([0], breaks + 1))].tolist()
    ends = (up[np.concatenate((breaks, [len(up) - 1]))] + 1).tolist()
    for start, end in zip(starts, ends, strict=True):
        low, high = total[start], total[end]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append((low, high, start, end, j))
                break
            low, start = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, float(h - lo)) for lo, h, s, e, _ in found]


def tokens_of(text: bytes) -> list[bytes]:
    return _TOKEN.findall(text)


def prefixes_of(token: bytes) -> list[bytes]:
    return [b"^" + token[:n] for n in PREFIXES if n < len(token)]


class TokenScores(dict):
    """Scores of tokens as they are met; starts anew when it holds ``REMEMBERED``."""

    def __init__(self, model: Model):
        super().__init__()
        self.named = model.scores

    def __missing__(self, token: bytes) -> float:
        named = self.named
        known = next((f for f in (token, *prefixes_of(token)) if f in named), None)
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = value = -DRIFT if known is None else named[known]
        return value

    def of(self, text: bytes) -> np.ndarray:
        return np.array([self[t] for t in tokens_of(text)], np.float64)


def passages(values: np.ndarray, model: Model) -> tuple[list[tuple[int, int, float]], float]:
    """The significant segments of a text's token scores, and their evidence."""
    chance = np.log(max(1, len(values)) * model.scale)
    out, evidence = [], 0.0
    for start, end, score in segments(values):
        over = model.decay * score - chance
        if over > -np.log(EXPECTED):
            out.append((start, end, score))
            evidence += float(over)
    return out, evidence


def id_bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets))


def training_sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, text`` of about ``SAMPLE`` labelled documents of each class, equal texts once."""
    by_doc = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic")
    )
    counts = {r["toxic"]: r["n"] for r in by_doc.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    limit = F.when(F.col("toxic"), SAMPLE / counts.get(True, 1)).otherwise(SAMPLE / counts.get(False, 1))
    chosen = by_doc.where(share < limit)  # a few thousand ids, whatever the table's size
    rows = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return checkpointed(rows.select("toxic", "text").dropDuplicates())


def token_counts(sample: DataFrame) -> DataFrame:
    """``token, toxic, clean, in_toxic, in_clean``: occurrences and documents of tokens and prefixes."""
    names = ["token", "toxic", "clean", "in_toxic", "in_clean"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                seen = {True: Counter(), False: Counter()}
                docs = {True: Counter(), False: Counter()}
                for toxic, text in zip(part.column("toxic").to_pylist(), lowered(part.column("text")), strict=True):
                    tokens = Counter(tokens_of(text))
                    own = Counter(tokens)
                    for token, n in tokens.items():
                        for p in prefixes_of(token):
                            own[p] += n
                    seen[toxic].update(own)
                    docs[toxic].update(own.keys())
                found = list(docs[True] | docs[False])
                counts = [[c[k][t] for t in found] for c in (seen, docs) for k in (True, False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=names
                )

    rows = sample.mapInArrow(lean(count), "token binary, toxic long, clean long, in_toxic long, in_clean long")
    return rows.groupBy("token").agg(*[F.sum(c).alias(c) for c in names[1:]])


def named_scores(sample: DataFrame) -> dict[bytes, float]:
    """Scores of the most significant tokens and prefixes; none if a class is missing."""
    docs = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = checkpointed(token_counts(sample))
    n = counts.where("substr(token, 1, 1) <> X'5E'").agg(F.sum("toxic"), F.sum("clean")).first()
    if len(docs) < 2 or not n[0] or not n[1]:
        return {}
    prior = PRIOR * (F.col("toxic") + F.col("clean")) / float(n[0] + n[1])
    toxic, clean = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(toxic / (n[0] + PRIOR - toxic)) - F.log(clean / (n[1] + PRIOR - clean))
    both = F.col("in_toxic") + F.col("in_clean")
    ratio = sum(
        F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * sum(docs.values()) / (both * docs[k]))).otherwise(0.0)
        for c, k in (("in_toxic", True), ("in_clean", False))
    )
    far = F.sqrt(F.greatest(F.lit(0.0), 2 * ratio))
    terms = (
        counts.select("token", odds.alias("odds"), far.alias("far"), both.alias("docs"))
        .where((F.col("far") >= SIGNIFICANT) & (F.col("docs") >= MIN_DOCS))
        .orderBy(F.desc("far"), "token")
        .limit(TERMS)
        .collect()
    )
    return {bytes(r["token"]): r["odds"] - DRIFT for r in terms}


def fitted(documents: DataFrame, labels: DataFrame) -> Model:
    sample = training_sample(documents, labels)
    scores = named_scores(sample)
    if not scores:
        return Model()
    values = np.array(_clean_scores(sample, Model(scores)))
    decay = decay_of(values[:, 0], values[:, 1] / values[:, 1].sum())
    best = _summaries(sample, Model(scores, decay))
    clean = [r for r in best if not r["toxic"] and r["tokens"]]
    spread = sum(r["tokens"] * np.exp(-decay * r["best"]) for r in clean)
    scale = len(clean) / spread if spread else 1.0
    again = _summaries(sample, Model(scores, decay, scale))
    slope, intercept = logistic(
        np.array([r["evidence"] for r in again]), np.array([float(r["toxic"]) for r in again])
    )
    return Model(scores, decay, scale, slope, intercept)


def _clean_scores(sample: DataFrame, model: Model) -> list[tuple[float, int]]:
    """Token scores in clean documents, to two digits, with how often they occur."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TokenScores(model)
        for batch in parts(batches):
            found = np.concatenate([scores.of(t) for t in lowered(batch.column("text"))] or [np.zeros(0)])
            values, n = np.unique(found.round(2), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["value", "n"])

    rows = sample.where("NOT toxic").mapInArrow(lean(tally), "value double, n long")
    return [(r[0], r[1]) for r in rows.groupBy("value").agg(F.sum("n")).collect()] or [(-DRIFT, 1)]


def decay_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of ``sum(shares * exp(x * scores)) = 1``; 1 if no token scores above zero."""
    if not (scores[shares > 0] > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    moment = lambda x: float((shares * np.exp(np.minimum(700, x * scores))).sum())
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below zero) and intercept by damped Newton steps, with a little ridge."""
    scale = max(1.0, float(x.std()))
    z = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w += np.clip(np.linalg.solve(hessian, z.T @ (y - p) - 1e-3 * w), -2, 2)
    return max(0.0, w[0] / scale), float(w[1])


def _summaries(sample: DataFrame, model: Model) -> list:
    """Best segment, evidence and size of every document of the bounded sample."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TokenScores(model)
        for batch in parts(batches):
            values = [scores.of(t) for t in lowered(batch.column("text"))]
            best = [max((s for _, _, s in segments(v)), default=0.0) for v in values]
            evidence = [passages(v, model)[1] for v in values]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array(best, pa.float64()),
                    pa.array(evidence, pa.float64()),
                    pa.array([len(v) for v in values], pa.int64()),
                ],
                names=["toxic", "best", "evidence", "tokens"],
            )

    return sample.mapInArrow(lean(summary), "toxic boolean, best double, evidence double, tokens long").collect()


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """Per document ``doc_id, score, predicted, evidence, n_tokens, passages``; passages are token ranges."""
    kind = dict(documents.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = TokenScores(model)
        for batch in parts(batches):
            sizes, evidence, spans = [], [], []
            for text in lowered(batch.column("text")):
                values = scores.of(text)
                found, over = passages(values, model)
                sizes.append(len(values))
                evidence.append(over)
                spans.append([{"start": s, "end": e, "score": v} for s, e, v in found])
            p = model.probability(np.array(evidence, np.float64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(p, pa.float64()),
                    pa.array((p >= 0.5).astype(np.int32)),
                    pa.array(evidence, pa.float64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(spans, span),
                ],
                names=["doc_id", "score", "predicted", "evidence", "n_tokens", "passages"],
            )

    schema = (
        f"doc_id {kind}, score double, predicted int, evidence double, n_tokens long, "
        "passages array<struct<start: long, end: long, score: double>>"
    )
    return documents.select("doc_id", "text").mapInArrow(lean(score), schema)
