"""Ranked lexical search: accumulators from short lists beside skipping over long ones.

1. The documents become an index in the shared folder: per document its length in terms and the numbers
   of occurrences of the terms that some query holds (others pass now and then; they only cost room).
   Statistics (documents, terms, document frequencies) are summed from it over all rows.
2. Queries go in blocks of about ``BLOCK`` terms; for each block every task searches its part of the
   index in shards of about ``SHARD`` postings. A shard inverts its postings and works out every score
   contribution once.
3. Per query the short lists, together at most ``SHORT`` of the shard's documents, are read term at a
   time into summed accumulators. These become one more iterator with its own bounds, which
   walks document at a time together with the long lists. Documents go in blocks of
   ``SKIP``; a block is skipped if the sum of its lists' maxima can't reach the threshold, the
   best score that ``k`` documents are known to reach, also from the task's earlier shards.
4. Every task returns its ``k`` best of each query; a window ranks these.

Bounds and scores are 64-bit integers, and a document that may tie with the threshold is never skipped, so
the ranks are exact. Terms are known by 64-bit hashes. Nothing grows with the number of documents
but the index, the number of tasks and their ``k`` rows per query.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after A-Z became lower case. Defined results:
null, empty and termless texts count nowhere and are never found; equal scores are in order of
``doc_id``, documents without one last and returned with null; rows that repeat a ``doc_id`` are documents of their
own, and so are benchmark rows that repeat an ``item_id``; items without terms or without matching
documents return no row; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.llm.hashing import NOT_ALNUM, HashTable, Words
from leadsieve.llm.tables import Bits, forget, lowered, slices, written

K = 10

#: Query terms of one block, about; a block's queries are sent to every task.
BLOCK = 1 << 20

#: Postings that a task inverts at a time.
SHARD = 1 << 21

#: Part of a shard's documents that the short lists of a query may name together.
SHORT = 1 / 16

#: Documents that are skipped together, and blocks that are read before the threshold is raised.
SKIP, STRIDE = 64, 64

#: Bytes of a long text that are cut into terms at a time.
PIECE = 1 << 20

_SIGN = np.uint64((1 << 63) - 1)


def pieces(text: bytes, limit: int = PIECE) -> list[bytes]:
    """``text`` in runs of about ``limit`` bytes that end between terms."""
    out, at = [], 0
    while len(text) - at > limit:
        end = at + limit
        while end < len(text) and not NOT_ALNUM[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every term of the texts."""
    owners, hashes = [], []
    cut = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
    at = 0
    while at < len(cut):
        end, size = at + 1, len(cut[at][1])
        while end < len(cut) and size + len(cut[end][1]) <= PIECE:
            size += len(cut[end][1])
            end += 1
        words = Words([p for _, p in cut[at:end]], NOT_ALNUM)
        owners.append(np.repeat([i for i, _ in cut[at:end]], np.diff(words.first)))
        hashes.append(words.hash & _SIGN)
        at = end
    if not cut:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and number of occurrences of every distinct term of every owner, in order."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    turn = np.ones(len(owner), bool)
    turn[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(turn)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def _lists(owner: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """Per row the values that it owns, as a list; owners are in order."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def queries(benchmark: DataFrame) -> DataFrame:
    """``q, item_id, terms, reps``: every item with terms, its distinct terms and their repeats."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, term, reps = counted(*term_hashes(lowered(part.column("text"))))
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("q"),
                        part.column("item_id"),
                        _lists(owner, term.astype(np.int64), rows, pa.int64()),
                        _lists(owner, reps, rows, pa.int64()),
                    ],
                    names=["q", "item_id", "terms", "reps"],
                )

    kind = dict(benchmark.dtypes)["item_id"]
    rows = benchmark.select(F.monotonically_increasing_id().alias("q"), "item_id", "text")
    found = rows.mapInArrow(cut, f"q long, item_id {kind}, terms array<long>, reps array<long>")
    return found.where(F.size("terms") > 0)


def index(documents: DataFrame, wanted: Bits) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with terms; ``terms`` are those that ``wanted`` may hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, term = term_hashes(lowered(part.column("text")))
                n = np.bincount(owner, minlength=part.num_rows)
                hit = wanted.has(term)
                owner, term, tf = counted(owner[hit], term[hit])
                rows = part.num_rows
                out = pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        _lists(owner, term.astype(np.int64), rows, pa.int64()),
                        _lists(owner, tf, rows, pa.int64()),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )
                yield out.filter(pa.array(n > 0))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id long, n long, terms array<long>, tfs array<long>")


def frequencies(indexed: DataFrame) -> DataFrame:
    """``term, df``: in how many documents each term of the index occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, df = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df, pa.int64())], names=["term", "df"])

    partial = indexed.select("terms").mapInArrow(count, "term long, df long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"))


class Block:
    """Some queries with the weights of their terms, small enough for every task."""

    def __init__(self, rows: list, df: dict[int, int], documents: int, terms: int):
        """``rows``: ``(q, terms, reps)``; ``documents`` and ``terms`` are N and L."""
        known = sorted({t for _, ts, _ in rows for t in ts})
        place = {t: i for i, t in enumerate(known)}
        self.hashes = np.array(known, np.uint64)
        self.weights = np.array([weight(documents, df.get(t, 0)) for t in known], np.int64)
        self.queries = [(q, np.array([place[t] for t in ts]), np.array(reps, np.int64)) for q, ts, reps in rows]
        self.documents, self.terms = documents, terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Shard:
    """The inverted lists of some documents, which are numbered in order of ``doc_id``."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, block: Block):
        """``n``: lengths of the documents; ``owner, term, tf``: postings in order of owner."""
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = owner[order], term[order], tf[order]
        self.docs = len(n)
        self.first = np.searchsorted(term, np.arange(len(block.weights) + 1))
        m = 25 + (75 * n * block.documents) // block.terms
        self.score = block.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.blocks = -(-self.docs // SKIP)
        self._maxima: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, term: int) -> slice:
        return slice(self.first[term], self.first[term + 1])

    def bounds(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a term's list, the largest contribution within each block of documents, and where blocks begin."""
        if term in self._maxima:
            return self._maxima[term]
        span = self.postings(term)
        found = block_bounds(self.doc[span], self.score[span], self.blocks)
        if span.stop - span.start >= self.blocks:  # never more room than the list itself takes
            self._maxima[term] = found
        return found


def block_bounds(docs: np.ndarray, scores: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.searchsorted(docs, np.arange(blocks + 1) * SKIP)
    most = np.zeros(blocks, np.int64)
    some = edges[1:] > edges[:-1]
    if some.any():
        most[some] = np.maximum.reduceat(scores, edges[:-1][some])
    return most, edges


def accumulated(shard: Shard, terms: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the terms' lists, in order, and the sums of their contributions."""
    spans = [shard.postings(t) for t in terms.tolist()]
    docs = np.concatenate([shard.doc[s] for s in spans] or [np.zeros(0, np.int64)])
    sums = np.concatenate([shard.score[s] * r for s, r in zip(spans, reps.tolist(), strict=True)] or [np.zeros(0, np.int64)])
    if not len(docs):
        return docs, sums
    order = np.argsort(docs, kind="stable")
    docs, sums = docs[order], sums[order]
    at = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return docs[at], np.add.reduceat(sums, at)


def best(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, of equals those of the first documents."""
    order = np.lexsort((docs, -scores))[:k]
    return scores[order], docs[order]


def search(shard: Shard, terms: np.ndarray, reps: np.ndarray, k: int, known: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Scores and documents of the shard that may be among a query's ``k`` best.

    ``known``: a score that ``k`` other documents reach, at least 1; what stays below is left out.
    """
    sizes = shard.first[terms + 1] - shard.first[terms]
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    short = np.cumsum(sizes[order]) <= shard.docs * SHORT
    long = order[~short].tolist()
    acc_docs, acc_sums = accumulated(shard, terms[order[short]], reps[order[short]])
    top_scores, top_docs = best(acc_sums, acc_docs, k)
    if not long:
        some = top_scores >= known
        return top_scores[some], top_docs[some]
    # long lists only add, so k accumulators are a threshold already
    least = max(known, int(top_scores[-1])) if len(top_scores) == k else known
    iterators = [(acc_docs, acc_sums, 1, *block_bounds(acc_docs, acc_sums, shard.blocks))] if len(acc_docs) else []
    for i in long:
        term, span = int(terms[i]), shard.postings(int(terms[i]))
        iterators.append((shard.doc[span], shard.score[span], int(reps[i]), *shard.bounds(term)))
    reach = sum(most * rep for _, _, rep, most, _ in iterators)
    top_scores, top_docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.flatnonzero(reach >= least)
    while len(left):
        now, left = left[:STRIDE], left[STRIDE:]
        sums = np.zeros((len(now), SKIP), np.int64)
        for docs, scores, rep, _, edges in iterators:
            low, size = edges[now], edges[now + 1] - edges[now]
            at = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
            sums[np.repeat(np.arange(len(now)), size), docs[at] % SKIP] += scores[at] * rep
        row, column = np.nonzero(sums >= least)
        found = now[row] * SKIP + column
        top_scores, top_docs = best(
            np.concatenate((top_scores, sums[row, column])), np.concatenate((top_docs, found)), k
        )
        if len(top_scores) == k and top_scores[-1] > least:
            least = int(top_scores[-1])
            left = left[reach[left] >= least]
    return top_scores, top_docs


def shards(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[pa.Array, Shard]]:
    """The documents of a task in runs of about ``SHARD`` postings: their ids and inverted lists."""
    places = HashTable(block.hashes)
    held: list[tuple] = []
    size = 0

    def cut() -> tuple[pa.Array, Shard]:
        ids = pa.concat_arrays([h[0] for h in held])
        n, sizes, term, tf = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
        order = pa.compute.sort_indices(ids).to_numpy().astype(np.int64)  # nulls come last
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owner = np.repeat(rank, sizes)
        by_owner = np.argsort(owner, kind="stable")
        shard = Shard(n[order], owner[by_owner], term[by_owner], tf[by_owner], block)
        return ids.take(pa.array(order)), shard

    for batch in batches:
        lists, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
        term = places.find(lists.flatten().to_numpy().astype(np.uint64))
        hit = term >= 0
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        per_doc = np.bincount(owner[hit], minlength=batch.num_rows)
        some = np.flatnonzero(per_doc)  # a document without any of the terms is found by no query
        ids, n, per_doc = batch.column("doc_id").take(pa.array(some)), batch.column("n").to_numpy()[some], per_doc[some]
        begin = np.concatenate(([0], np.cumsum(per_doc)))
        term, tf = term[hit].astype(np.int64), tfs[hit]
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(begin, begin[at] + SHARD - size, "right")) - 1)
            span = slice(begin[at], begin[end])
            held.append((ids.slice(at, end - at), n[at:end], per_doc[at:end], term[span], tf[span]))
            size += int(begin[end] - begin[at])
            at = end
            if size >= SHARD or at < len(some):
                yield cut()
                held, size = [], 0
    if held:
        yield cut()


def found(indexed: DataFrame, block: Block, k: int) -> DataFrame:
    """``q, doc_id, score``: what each task holds of the block's ``k`` best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[tuple] = [(np.zeros(0, np.int64), pa.array([], pa.int64()))] * len(block.queries)
        for ids, shard in shards(batches, block):
            for i, (_, terms, reps) in enumerate(block.queries):
                before, before_ids = tops[i]
                known = int(before[-1]) if len(before) == k else 1
                scores, docs = search(shard, terms, reps, k, known)
                if len(scores):
                    scores, both = np.concatenate((before, scores)), pa.concat_arrays([before_ids, ids.take(pa.array(docs))])
                    order = np.lexsort((pa.compute.rank(both).to_numpy(), -scores))[:k]
                    tops[i] = scores[order], both.take(pa.array(order))
        qs = np.repeat([q for q, _, _ in block.queries], [len(s) for s, _ in tops])
        yield pa.RecordBatch.from_arrays(
            [pa.array(qs, pa.int64()), pa.concat_arrays([x for _, x in tops]), pa.array(np.concatenate([s for s, _ in tops]))],
            names=["q", "doc_id", "score"],
        )

    return indexed.mapInArrow(run, "q long, doc_id long, score long")


def lexical_search(documents: DataFrame, benchmark: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every benchmark row."""
    asked = written(queries(benchmark))
    indexed = written(index(documents, Bits(asked.select(F.explode("terms")))))
    total = indexed.agg(F.count("*"), F.sum("n")).first()
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    df = written(frequencies(indexed).join(wanted, "term"))
    blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block
    of_block = F.pmod(F.xxhash64("q"), F.lit(blocks))
    tops = []
    for b in range(blocks):
        mine = asked.where(of_block == b)
        rows = [(r.q, r.terms, r.reps) for r in mine.select("q", "terms", "reps").collect()]
        if not rows or not total[0]:
            continue
        known = df.join(mine.select(F.explode("terms").alias("term")).distinct(), "term").collect()
        tops.append(written(found(indexed, Block(rows, {r.term: r.df for r in known}, *total), k)))
    forget(documents.sparkSession, [indexed, df])
    schema = asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    if not tops:
        return schema.limit(0)
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
