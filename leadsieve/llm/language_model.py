"""Language-model scores of documents: a byte PPM model beside a unigram word model.

Both models are counted over all training documents. Tasks count the hashes of words and the
byte n-grams of their rows; one aggregation adds them up. Every counted n-gram is in the trie of the
PPM model, which is dealt to tasks by the last ``SHARED`` bytes of the contexts: all longer contexts a
symbol may be coded in meet in one task, and the short ones are sent to all. The shares of the
``NODES`` most frequent longest n-grams are sent to the tasks that read the texts, with the counts of the
``HOT`` most frequent words. The other words are joined with their counts by shuffle, and the other n-grams,
each once per document and run of rows, with their shares, worked out once per distinct n-gram.

Text is UTF-8 with A-Z in lower case; the PPM model codes its bytes and an end. Words are known by 64-bit hashes.

Defined results: null and empty texts are just the end; without training documents every symbol
and word is equally likely; rows are scored one by one even if they repeat a ``doc_id``; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.hashing import SPACES, HashTable, Words
from leadsieve.llm.ppm import Trie, grams_of
from leadsieve.llm.tables import checkpointed, lowered, slices, written

#: Bytes of context.
ORDER = 5

#: N-grams of the longest kind whose shares every task holds.
NODES = 1 << 20

#: Bytes of context by which the trie is dealt; n-grams with shorter contexts are sent to all tasks.
SHARED = 3

#: N-grams that a task of the dealt trie holds on average.
DEALT = 200_000

#: Words whose counts every task holds.
HOT = 1 << 20

#: Distinct counts that a task holds before it adds up what it has.
PENDING = 4_000_000

WORD, GRAM, DOCUMENT = 0, 1, 2

#: Hash of the end of a text as a token.
END_TOKEN = 0


_loaded: dict[str, tuple[HashTable, np.ndarray, HashTable, np.ndarray]] = {}


def _give_back() -> None:
    """Return freed memory to the system: workers live on, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class _Tally:
    """Counts of hashes, added up whenever many are pending."""

    def __init__(self):
        self.keys, self.counts, self.pending = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(n)
        self.pending += len(found)
        if self.pending > PENDING:
            self._sum()

    def _sum(self) -> None:
        if self.keys:
            keys, which = np.unique(np.concatenate(self.keys), return_inverse=True)
            n = np.bincount(which, np.concatenate(self.counts), len(keys)).astype(np.int64)
            self.keys, self.counts, self.pending = [keys], [n], len(keys)

    def batches(self, kind: int) -> Iterator[pa.RecordBatch]:
        self._sum()
        for keys, n in zip(self.keys, self.counts, strict=True):
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[at : at + 100_000])],
                    names=["kind", "key", "n"],
                )


def counted(training: DataFrame, order: int) -> DataFrame:
    """``kind, key, n`` of all words and the longest n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded.clear()  # of an earlier model
        words, grams = _Tally(), _Tally()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                docs = lowered(part.column("text"))
                words.add(np.append(Words(docs, SPACES).hash, np.full(len(docs), END_TOKEN, np.uint64)))
                grams.add(grams_of(docs, order)[0])
        yield from words.batches(WORD)
        yield from grams.batches(GRAM)
        del words, grams
        _give_back()

    rows = training.select("text").mapInArrow(count, "kind byte, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` rows reach."""
    n = F.col("n")
    step = F.when(n <= 4096, n).otherwise((4096 * F.pow(2.0, F.floor(F.log2(n / 4096.0)))).cast("long"))
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()  # some 4,100 rows
    least, total = 1, 0
    for step, rows in sorted(((r[0], r[1]) for r in found), reverse=True):
        total += rows
        if total > most:
            return least if least > 1 else step + 1
        least = step
    return 1


def all_lengths(counts: DataFrame, order: int) -> DataFrame:
    """``length, key, n`` of the n-grams of every length, from those of the longest."""
    low = [f"named_struct('length', {m}, 'key', key & {(1 << 8 * (m + 1)) - 1}L)" for m in range(order + 1)]
    each = counts.where(F.col("kind") == GRAM).selectExpr(f"inline(array({', '.join(low)}))", "n")
    return each.groupBy("length", "key").agg(F.sum("n").alias("n"))


def _load(name: str, held) -> tuple[HashTable, np.ndarray, HashTable, np.ndarray]:
    """The tables of a model, built once per Python worker."""
    if name not in _loaded:
        _loaded.clear()
        grams, shares, words, n = held.value
        _loaded[name] = HashTable(grams), shares, HashTable(words), np.log10(n + 1.0)
    return _loaded[name]


def shares_of(wanted: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """``key, share`` of the distinct keys in ``wanted``, by the trie of all ``grams``."""
    spark = wanted.sparkSession
    low = grams.where(F.col("length") < SHARED).toArrow()  # at most 256 ** SHARED rows of each length
    shared = spark.sparkContext.broadcast(tuple(low[c].to_numpy() for c in ("length", "key", "n")))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _loaded.clear()
        own = [[b.column(c).to_numpy() for c in ("length", "key", "n")] for b in batches if b.num_rows]
        if not own:
            return
        lengths, keys, n = (np.concatenate(x) for x in zip(*own, shared.value, strict=True))
        own.clear()
        asked = keys[lengths < 0].astype(np.uint64)
        if not len(asked):
            return
        trie = Trie(
            [keys[lengths == m].astype(np.uint64) for m in range(order + 1)],
            [n[lengths == m] for m in range(order + 1)],
        )
        for at in range(0, len(asked), 100_000):
            part = asked[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int64)), pa.array(trie.log_shares(part))], names=["key", "share"]
            )
        del trie, lengths, keys, n, asked, part
        _give_back()

    deep = grams.where(F.col("length") >= SHARED).select("length", "key", "n")
    rows = deep.unionByName(wanted.select(F.lit(-1).alias("length"), "key", F.lit(0).cast("long").alias("n")))
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    tasks = max(1, -(-rows.count() // DEALT))
    return rows.repartition(tasks, context).mapInArrow(share, "key long, share double")


def scored(documents: DataFrame, training: DataFrame, order: int = ORDER, nodes: int = NODES, hot: int = HOT) -> DataFrame:
    """Per document ``doc_id, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = documents.sparkSession
    counts = checkpointed(counted(training, order))
    words, longest = (counts.where(F.col("kind") == k) for k in (WORD, GRAM))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = words.where(F.col("key") == END_TOKEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grams = checkpointed(all_lengths(counts, order))
    least_gram, least_word = least_count(longest, nodes), least_count(words, hot)
    often = longest.where(F.col("n") >= least_gram).select("key")
    kept = shares_of(often, grams, order).toArrow()  # at most ``nodes`` rows
    near = words.where(F.col("n") >= least_word).select("key", "n").toArrow()  # at most ``hot`` rows
    held = spark.sparkContext.broadcast(
        (
            kept["key"].to_numpy().astype(np.uint64),
            kept["share"].to_numpy(),
            near["key"].to_numpy().astype(np.uint64),
            near["n"].to_numpy(),
        )
    )
    rows = written(_scored_rows(documents, held, order, end))
    held.destroy()
    wanted = checkpointed(rows.where(F.col("kind") == GRAM).select("key").distinct())
    value = F.log10(F.col("n") + 1).alias("value")
    rare = words.where(F.col("n") < least_word).select("kind", "key", value)
    rare = rare.unionByName(
        shares_of(wanted, grams, order).select(F.lit(GRAM).cast("byte").alias("kind"), "key", F.col("share").alias("value"))
    )
    met = rows.join(rare, ["kind", "key"], "left")
    is_word, is_gram = F.col("kind") == WORD, F.col("kind") == GRAM
    per_doc = met.groupBy("doc_id", "row").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.count(F.when(is_word, F.col("value")))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(is_word, F.coalesce("value", F.lit(0.0))).otherwise(0.0))).alias("base"),
        (F.sum("score") + F.sum(F.when(is_gram, F.col("value") * F.col("times")).otherwise(0.0))).alias("score"),
    )
    room = float(np.log10(total + distinct + 1))
    return per_doc.select(
        "doc_id",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * room).alias("base_score"),
        "score",
    )


def _scored_rows(documents: DataFrame, held, order: int, end: int) -> DataFrame:
    """A row per document with what is known of it, and others for words and n-grams that are not among the frequent ones."""
    name = uuid.uuid4().hex
    names = ["doc_id", "row", "kind", "key", "n_tokens", "n_known", "base", "score", "times"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, shares, table, logs = _load(name, held)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                docs = lowered(part.column("text"))
                words = Words(docs, SPACES)
                sizes = np.diff(words.first)
                owner = np.repeat(np.arange(len(docs)), sizes)
                place = table.find(words.hash)
                near = place >= 0
                far, every = ~near, np.arange(len(docs))
                base = np.bincount(owner[near], logs[place[near]], len(docs)) + np.log10(end + 1)
                known = np.bincount(owner[near], minlength=len(docs)) + (end > 0)
                keys, first = grams_of(docs, order)
                of = np.repeat(np.arange(len(docs)), np.diff(first))
                place = grams.find(keys)
                known_gram = place >= 0
                share = np.bincount(of[known_gram], shares[place[known_gram]], len(docs))
                keys, of = keys[~known_gram], of[~known_gram]
                sort = np.lexsort((keys, of))
                keys, of = keys[sort], of[sort]
                new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))[: len(keys)])
                times = np.diff(np.append(new, len(keys)))
                keys, of = keys[new], of[new]
                rest = np.zeros(int(far.sum()) + len(keys))
                row = pa.array(np.concatenate((every, owner[far], of)))
                kinds = np.repeat([DOCUMENT, WORD, GRAM], [len(docs), int(far.sum()), len(keys)]).astype(np.int8)
                columns = [
                    kinds,
                    np.concatenate((part.column("row").to_numpy(), words.hash[far].astype(np.int64), keys.astype(np.int64))),
                    np.concatenate((sizes + 1, rest)).astype(np.int64),
                    np.concatenate((known, rest)).astype(np.int64),
                    np.concatenate((base, rest)),
                    np.concatenate((share, rest)),
                    np.concatenate((np.ones(len(docs) + int(far.sum()), np.int64), times)),
                ]
                ids = [part.column(c).take(row) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, columns)], names=names)
        _give_back()

    kind = dict(documents.dtypes)["doc_id"]
    schema = (
        f"doc_id {kind}, row long, kind byte, key long, n_tokens long, n_known long, base double, score double, "
        "times long"
    )
    rows = documents.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(score, schema)
