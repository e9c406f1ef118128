"""Lexical search, SimHash balls and Shallot clustering against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from leadsieve.llm import centroids, lexical_search, simhash
from leadsieve.llm.tables import components
from tests.llm.conftest import EDGES
from tests.llm.test_dedup import union

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- search


def terms_of(text):
    return TERM.findall((text or "").encode().lower())


def brute_search(docs, items, k=10):
    """``docs``: ``(doc_id, text)`` pairs; ``items``: ``(item_id, text)`` pairs."""
    bags = [(i, terms_of(t)) for i, t in docs]
    bags = [b for b in bags if b[1]]
    n, total = len(bags), sum(len(t) for _, t in bags)
    df = {}
    for _, ts in bags:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, ts in bags:
            m = 25 + (75 * len(ts) * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 8 * m))
                for t in terms_of(text)
                if t in ts
            )
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def prose(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, words))) for _ in range(n)]


def ranked(docs, items, **more):
    return sorted((tuple(r) for r in lexical_search.lexical_search(docs, items, **more).collect()), key=repr)


def as_items(docs, rows):
    return docs.sparkSession.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize(("shard", "block", "k"), [(1 << 21, 1 << 20, 10), (900, 1 << 20, 10), (300, 40, 3)])
def test_search(documents, monkeypatch, shard, block, k):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "SKIP", 8)
    monkeypatch.setattr(lexical_search, "STRIDE", 2)
    texts = list(enumerate(prose(1, 700, 40)))
    random.Random(2).shuffle(texts)
    items = list(enumerate(prose(3, 12, 25)))
    docs = documents(texts)
    assert ranked(docs, as_items(docs, items), k=k, block=block) == brute_search(texts, items, k)


def test_search_edges(documents):
    texts = [*EDGES, (9, "Straße ONE"), (10, "one one two"), (11, "one one two"), (12, "zz!! one-two")]
    items = [(1, "one"), (1, "one"), (2, None), (3, ""), (4, "here again again"), (5, "nothing"), (6, "straße"), (None, "word two")]
    docs = documents(texts).selectExpr("*", "1 AS q", "1 AS n", "1 AS rank", "1 AS item_id", "1 AS `with ``tick``.dot`")
    asked = as_items(docs, items).selectExpr("*", "1 AS doc_id", "1 AS score", "1 AS terms")
    assert ranked(docs, asked) == brute_search(texts, items)
    assert ranked(documents([]), asked) == []
    assert ranked(documents([(1, None)]), asked) == []
    assert ranked(docs, as_items(docs, [])) == []


def test_long_texts_are_cut_between_terms():
    text = b"alpha " * 5000 + b"x" * 3000 + b" beta" + b"." * 4000 + b"gamma"
    for limit in (1, 7, 1000):
        cut = lexical_search.pieces(text, limit)
        assert b"".join(cut) == text
        assert [t for p in cut for t in TERM.findall(p)] == TERM.findall(text)


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 12), st.integers(1, 5), st.integers(0, 3))
def test_hybrid_search_of_a_shard(seed, docs, terms, k, scale):
    rng = np.random.default_rng(seed)
    held = rng.random((docs, terms)) < rng.random(terms)
    owner, term = np.nonzero(held)
    tf = rng.integers(1, 2 + 10**scale, len(owner))
    n = 1 + np.bincount(owner, tf, docs).astype(np.int64)
    block = lexical_search.Block([(0, list(range(terms)), [1] * terms)], {t: int(held[:, t].sum()) for t in range(terms)}, docs, int(n.sum()))
    shard = lexical_search.Shard(n, owner, term, tf, block)
    reps = rng.integers(1, 4, terms)
    dense = np.zeros((terms, docs), np.int64)
    for t in range(terms):
        dense[t, shard.doc[shard.postings(t)]] = shard.score[shard.postings(t)]
    total = reps @ dense
    want = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s > 0))[:k]
    scores, found = lexical_search.search(shard, np.arange(terms), reps, k)
    assert list(zip((-scores).tolist(), found.tolist())) == want
    if len(want) == k:  # a threshold that is just reached drops nothing above or at it
        scores, found = lexical_search.search(shard, np.arange(terms), reps, k, -want[-1][0])
        assert list(zip((-scores).tolist(), found.tolist())) == want


# --- SimHash


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    smallest = {}
    for (i, _), r in zip(rows, roots):
        smallest[r] = min(filter(lambda x: x is not None, (i, smallest.get(r))), default=None)
    return sorted(((i, f"{f:016x}", smallest[r]) for (i, _), f, r in zip(rows, fps, roots)), key=repr)


def test_simhash(documents, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 5000)
    monkeypatch.setattr(simhash, "PACK", 7)
    rng = random.Random(8)
    rows = []
    for base in prose(4, 25, 400):
        for _ in range(rng.randint(1, 6)):
            words = base.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), "  ".join(words)))
    rows += [(1000 + i, t) for i, t in EDGES if i] + [(None, "alone without number"), (None, None)]
    docs = documents(rows).selectExpr("*", "1 AS fp", "1 AS component", "1 AS fingerprint")
    got = simhash.simhash_dedup(docs).collect()
    want = brute_simhash(rows)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    linked = [w for w in want if w[0] != w[2] and int(w[1], 16)]
    assert len(linked) > 20 and len({w[1] for w in want}) > len({w[2] for w in want})
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert simhash.simhash_dedup(documents([])).collect() == []


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.integers(0, 2**64 - 1), st.lists(st.sets(st.integers(0, 63), max_size=5), min_size=1, max_size=12))
def test_balls_link_all_within_three_bits(base, flips):
    fps = sorted({base ^ sum(1 << b for b in f) for f in flips})
    links = simhash.stars(simhash.balls(np.array(fps, np.uint64))).tolist()
    place = {f: i for i, f in enumerate(fps)}
    want = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3]
    assert union(len(fps), [(place[a], place[b]) for a, b in links]) == union(len(fps), want)
    assert all((a ^ b).bit_count() <= 3 for a, b in links)


def test_a_large_ball_of_fingerprints(spark):
    """Thousands of fingerprints round one centre: links stay in proportion to the variants' members."""
    rng = random.Random(5)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(2500)})
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(frame, 50)
    found = components(links)
    assert found.count() == len(fps) and found.select("component").distinct().count() == 1


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.text("ab \t\nÄß", max_size=40), max_size=8), st.integers(1, 4))
def test_fingerprints_of_a_run(texts, width):
    got = simhash.text_fingerprints([t.encode().lower() for t in texts], width)
    assert got.tolist() == [brute_fingerprint(t, width) for t in texts]


def test_majorities_of_many_hashes():
    rng = np.random.default_rng(6)
    sizes = np.array([0, 1, 255, 256, 1000, 0, 4, 70_000])
    hashes = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, sizes.sum(), dtype=np.uint64)
    want = [
        sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
        for h in np.split(hashes, np.cumsum(sizes)[:-1])
    ]
    assert simhash.majorities(hashes, sizes).tolist() == want


# --- clustering


def lloyd(rows, k, rounds):
    """``rows``: ``(vec_id, components)`` of kept vectors, in integers."""
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    places = [list(v) for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(places))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for c in range(len(places)):
            mine = [v for (_, v), o in zip(rows, own) if o == c]
            if mine:
                places[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, c, d) for (i, v) in rows for d, c in [nearest(v)]), key=repr), places


def as_vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("spread", [0.01, 0.5])
def test_clusters(spark, spread):
    rng = np.random.default_rng(12)
    middles = rng.normal(size=(6, 5))
    data = (middles[rng.integers(0, 6, 300)] + rng.normal(size=(300, 5)) * spread).astype(np.float32)
    data = np.concatenate((data, data[:20]))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    got, places = centroids.clustered(as_vectors(spark, [(*r, 0) for r in rows]), k=7, rounds=6, dimensions=5)
    want, want_places = lloyd([(i, [math.floor(1024 * x) for x in v]) for i, v in rows], 7, 6)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert places.tolist() == want_places


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 3), st.sampled_from([1, 3, 50]))
def test_shallot_rounds(seed, k, dimensions, size):
    """Small grids of integers, full of ties: every round agrees with the full search."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-size, size + 1, (60, dimensions))
    places = rng.integers(-size, size + 1, (k, dimensions))
    none = np.full(60, -1, np.int32)
    state, at = (none, none, np.zeros(60), np.zeros(60)), centroids.centroids_at(places)
    for _ in range(5):
        *state, distance = centroids.assigned(vectors, tuple(state), at, True)
        full = np.array([centroids.squares(vectors - p) for p in at.places])
        assert state[0].tolist() == full.argmin(axis=0).tolist()
        assert distance.tolist() == full.min(axis=0).tolist()
        others = full.astype(float)
        others[state[0], np.arange(60)] = np.inf
        assert (state[3] <= np.sqrt(others.min(axis=0))).all()
        step = rng.integers(-1, 2, at.places.shape)
        at = centroids.centroids_at(at.places + step, at.places)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (2, [5.0, -1.5], 0), (None, [5.0, -1.0], 0), (3, None, 0), (4, [1.0], 0),
        (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, 2.0, 3.0], 0), (9, [-0.0001, 1e9], 0),
        (10, [], 0), (11, [100000.0, -100000.0], None),
    ]
    table = as_vectors(spark, rows).selectExpr("*", "1 AS cluster", "1 AS vector", "1 AS distance", "1 AS `with ``tick``.dot`")
    got, places = centroids.clustered(table, k=8, rounds=3, dimensions=2)
    usable = [(1, [0, 1024]), (2, [0, 1024]), (2, [5120, -1536]), (None, [5120, -1024]), (11, [102400000, -102400000])]
    want, want_places = lloyd(usable, 8, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=repr) == want
    assert places.tolist() == want_places
    for none in (as_vectors(spark, []), as_vectors(spark, [(None, [1.0, 2.0], 0)])):
        assert centroids.with_inertia(*centroids.clustered(none, dimensions=2)).collect() == []
