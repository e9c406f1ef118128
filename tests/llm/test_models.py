"""The language model, toxicity and language identification."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from leadsieve.llm import language_id, language_model, toxicity
from leadsieve.llm.hashing import HashTable
from leadsieve.llm.language_id import dictionaries, predicted, training_passages
from leadsieve.llm.ppm import Trie, grams_of


def trie_of(texts, order, least=1):
    keys, _ = grams_of(texts, order)
    grams, counts = [], []
    for m in range(order + 1):
        g, n = np.unique(keys & np.uint64((1 << 8 * (m + 1)) - 1), return_counts=True)
        grams.append(g[n >= least])
        counts.append(n[n >= least])
    return Trie(grams, counts)


@pytest.mark.parametrize("order", [0, 1, 2, 4])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_shares_of_all_symbols_sum_to_one(order, least):
    trie = trie_of([b"abracadabra", b"abracad", b"", b"barbara"], order, least)
    for context in (b"abra", b"xxxx", b"\xff\xff\xff\xff", b"xxra", b"acad"):
        base = int.from_bytes(context[4 - order :], "big") << 8 if order else 0
        keys = np.array([base | s for s in range(256)], np.uint64)
        assert math.isclose((10 ** trie.log_shares(keys)).sum(), 1, rel_tol=1e-9)


def brute_share(texts, order, context, symbol):
    """PPM with exclusion, counted by hand."""
    padded = [b"\xff" * order + t + b"\xff" for t in texts]
    excluded, share = set(), 1.0
    for m in range(order, -1, -1):
        seen = Counter(
            t[i] for t in padded for i in range(order, len(t)) if t[i - m : i] == context[order - m :]
        )
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        total = sum(left.values())
        if symbol in left:
            return share * (left[symbol] - 0.5) / total
        if left:
            share *= len(left) / 2 / total
        excluded = set(seen)
    return share / (256 - len(excluded))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=4), st.binary(min_size=3, max_size=3))
def test_trie_agrees_with_counting(texts, raw):
    query = bytes(97 + x % 4 for x in raw)
    got = trie_of(texts, 2).log_shares(np.array([int.from_bytes(query, "big")], np.uint64))[0]
    assert math.isclose(10**got, brute_share(texts, 2, query[:2], query[2]), rel_tol=1e-9)


def test_scores_against_counting(documents):
    texts = {i: t for i, t in enumerate(["The cat sat", "the dog", None, "a cat a cat", "new words", ""])}
    docs = documents(texts)
    training = docs.where("doc_id <> 4")
    counts = Counter(w for i, t in texts.items() if i != 4 for w in (t or "").lower().split())
    n, v = sum(counts.values()) + 5, len(counts) + 1
    for hot in (1000, 1):
        rows = {r.doc_id: r for r in language_model.scored(docs, training, order=2, hot=hot).collect()}
        for i, t in texts.items():
            words = (t or "").lower().split()
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10(6 / (n + v + 1))
            assert (rows[i].n_tokens, rows[i].train_tokens) == (len(words) + 1, n)
            assert rows[i].n_known == sum(w in counts for w in words) + 1
            assert math.isclose(rows[i].base_score, base, rel_tol=1e-9)
            data = b"\xff\xff" + (t or "").lower().encode() + b"\xff"
            trained = [(x or "").lower().encode() for k, x in texts.items() if k != 4]
            want = sum(math.log10(brute_share(trained, 2, data[k - 2 : k], data[k])) for k in range(2, len(data)))
            assert math.isclose(rows[i].score, want, rel_tol=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=20))
def test_hash_table(known, others):
    keys = np.array(sorted(known), np.uint64)
    table = HashTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    strange = np.array(sorted(others - known), np.uint64)
    assert (table.find(strange) == -1).all()


def brute_segments(values):
    """Maximal segments: the best one, then those of what lies left and right of it."""

    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += values[j]
                if total > 0 and (top is None or total > top[2]):
                    top = (i, j + 1, total)
        return [] if top is None else [*best(a, top[0]), top, *best(top[1], b)]

    return best(0, len(values))


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.lists(st.integers(-50, 50), max_size=25))
def test_segments_are_the_maximal_ones(raw):
    values = [x + (i + 1) / 1024 for i, x in enumerate(raw)]  # no ties and no zero
    got = toxicity.segments(np.array(values, float))
    want = brute_segments(values)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


@pytest.mark.parametrize(
    ("values", "want"),
    [([0, 0], []), ([0, 3], [(1, 2)]), ([3, 0], [(0, 1)]), ([2, -2, 2], [(0, 1), (2, 3)]), ([2, -1, 0, 1, 2], [(0, 5)]), ([-1, 0, 4, 0, 0, -4, 4], [(2, 3), (6, 7)])],
)
def test_stretches_that_add_nothing_are_left_out(values, want):
    assert [(a, b) for a, b, _ in toxicity.segments(np.array(values, float))] == want


def test_decay_solves_the_moment_equation():
    scores, shares = np.array([2.0, -1.0]), np.array([0.1, 0.9])
    assert math.isclose((shares * np.exp(toxicity.decay_of(scores, shares) * scores)).sum(), 1, rel_tol=1e-6)


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rng = np.random.default_rng(5)
    stems = ["lor", "mip", "sal", "ner", "tuv", "hax"]
    texts, labels = {}, []
    for i in range(600):
        words = ["".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[rng.integers(60)] = rng.choice(["vilest", "grubbo"]) + rng.choice(["", "ka", "mi"])
        texts[i] = " ".join(words)
        labels.append((i, int(toxic)))
    return documents(texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_documents_that_were_held_out(labelled):
    docs, labels = labelled
    model = toxicity.fitted(docs, labels.where("doc_id % 5 <> 0"))
    rows = toxicity.scored(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(s.end > s.start for r in rows for s in r.passages)


def test_no_labels_no_score(labelled):
    docs, labels = labelled
    model = toxicity.fitted(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.scored(docs.limit(20), model).collect()} == {0.0}


def test_languages_that_were_held_out(spark):
    rng = np.random.default_rng(6)
    syllables = {"aa": ["ke", "ti", "mo", "ra"], "bb": ["schu", "ung", "eit", "pf"], "cc": ["ção", "lha", "nho", "qu"]}
    rows = []
    for i in range(300):
        lang = list(syllables)[i % 3]
        words = ["".join(rng.choice(syllables[lang], 3)) for _ in range(rng.integers(3, 80))]
        rows.append((i, " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = dictionaries(training_passages(docs.where("doc_id % 4 <> 1")))
    got = predicted(docs, learned).join(docs, "doc_id").where("doc_id % 4 = 1").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    nothing = predicted(docs.limit(3), ()).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


@pytest.mark.parametrize("loaded", [64, 2])
def test_sizes_are_those_of_plain_compression(monkeypatch, loaded):
    monkeypatch.setattr(language_id, "LOADED", loaded)
    learned = dictionaries([("a", "lorem ipsum dolor"), ("b", "und der die"), ("a", "sit amet"), ("c", ""), ("d", "12 34")])
    assert learned[0] == ("a", b" lorem ipsum dolor  sit amet ")
    texts = [language_id.letters_of(t) for t in ("Lorem IPSUM 5 dolor!", "und die der " * 900, "é", "")]
    got = language_id.sizes(texts, learned)
    for row, text in zip(got.tolist(), texts, strict=True):
        for size, (_, content) in zip(row, learned, strict=True):
            total = 0
            for at in range(0, len(text), language_id.BLOCK):
                block = text[at : at + language_id.BLOCK]
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(
                    language_id.LEVEL, source_size=language_id.BLOCK, dict_size=len(content), write_content_size=False
                )
                total += len(zstandard.ZstdCompressor(compression_params=how, dict_data=known).compress(block))
            assert size == total


def test_three_hundred_languages_are_all_learned(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in range(300):
        stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        for k in range(3):
            rows.append((3 * n + k, " ".join(rng.choice(stems, 40)), f"l{n}"))
    rows += [(5000, "1234 5678", "digits"), (5001, None, "none"), (5002, "x" * 5000 + "1" * 9000, "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = dictionaries(training_passages(docs.where("doc_id % 3 <> 1")))
    assert {name for name, _ in learned} == {f"l{n}" for n in range(300)}
    got = predicted(docs.where("doc_id < 1000"), learned).join(docs, "doc_id").where("doc_id % 3 = 1").collect()
    assert len(got) == 300 and sum(r.lang == r.lang_pred for r in got) >= 297


def test_bucket_of_an_id(documents):
    docs = documents({i: "" for i in range(50)})
    got = docs.select("doc_id", toxicity.id_bucket(docs["doc_id"], 7).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 7 for r in got)


@pytest.mark.parametrize("nodes", [1 << 20, 40, 0])
def test_every_ngram_counts_however_few_are_held(documents, nodes):
    rng = np.random.default_rng(9)
    texts = {i: " ".join("".join(rng.choice(list("abcdé"), 3)) for _ in range(25)) for i in range(12)} | {20: "", 21: None, 22: "xyz é"}
    docs = documents(texts)
    trie = trie_of([(texts[i] or "").lower().encode() for i in range(8)], 5)
    assert sum(map(len, (trie.entries.keys,))) > 400
    for r in language_model.scored(docs, docs.where("doc_id < 8"), nodes=nodes).collect():
        keys, _ = grams_of([(texts[r.doc_id] or "").encode()], 5)
        assert math.isclose(r.score, trie.log_shares(keys).sum(), rel_tol=1e-9), r.doc_id
