"""Exact, near and line deduplication against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadsieve.llm import linking, near_dedup
from leadsieve.llm.exact_dedup import CuckooIndex, exact_dedup, live_digests, updated
from leadsieve.llm.hashing import SPACES, Words, char_shingle_sets, held
from leadsieve.llm import line_dedup as lines_module
from leadsieve.llm.line_dedup import band_members, groups_once, line_dedup, line_places, shared_bands
from leadsieve.llm.tables import components


def union(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(x) for x in range(n)]


def shingles(text, width):
    words = tuple(text.lower().split())
    if not words:
        return set()
    return {words[i : i + width] for i in range(max(1, len(words) - width + 1))}


def brute_components(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    return union(len(texts), links)


def copies(seed, groups=12, size=8, words=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=25))
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(3, words)) + passage.split()
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return [*texts, "", "one", "one", "two words", "Two  words"]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_copies(documents, width, percent):
    texts = copies(width)
    want = brute_components(texts, width, percent)
    assert 10 < len(set(want)) < len(texts)
    rows = near_dedup.near_dedup(documents(enumerate(texts)), width, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want))
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(texts[r.doc_id], width)) for r in rows)


def test_near_copies_in_many_chunks(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "LIST_CHUNK", 5)
    monkeypatch.setattr(near_dedup, "CHUNK", 300)
    texts = copies(9, groups=3, size=40)
    rows = near_dedup.near_dedup(documents(enumerate(texts)), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(brute_components(texts, 3, 85)))


def test_components(spark):
    rng = random.Random(3)
    chain = rng.sample(range(1000), 60)
    links = list(zip(chain, chain[1:])) + [(2000, x) for x in range(2001, 2100)] + [(5000, 5000), (7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    for together in (1000, 40):
        rows = components(frame, together).collect()
        assert {r.id: r.component for r in rows} == {x: min(chain) for x in chain} | {x: 2000 for x in range(2000, 2100)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 12), st.sets(st.tuples(st.integers(0, 11), st.integers(0, 11))))
def test_spanning_links(n, pairs):
    both = {(a, b) for x, y in pairs for a, b in ((x, y), (y, x)) if a < n and b < n}
    got = linking.spanning(n, lambda x, unseen: np.array([y for y in range(n) if unseen[y] and (x, y) in both], int))
    assert union(n, got) == union(n, both) and len(got) == n - len(set(union(n, both)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=10), st.sampled_from([50, 80, 85]))
def test_rarest_hashes_find_every_link(sets, percent):
    values = np.array([v for s in sets for v in sorted(s)], np.int64)
    linked = linking.by_rarest(values, np.array([len(s) for s in sets]), percent)
    for x, s in enumerate(sets):
        want = [y for y, t in enumerate(sets) if 100 * len(s & t) >= percent * len(s | t)]
        got = linked(x, np.ones(len(sets), bool)).tolist()
        assert set(got) | {x} == set(want)


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.lists(st.lists(st.sets(st.integers(0, 9), min_size=1), min_size=1, max_size=7), min_size=1, max_size=4), st.sampled_from([50, 80]))
def test_groups_side_by_side_give_every_link(groups, percent):
    sets = [s for g in groups for s in g]
    sizes, members = np.array([len(s) for s in sets]), np.array([len(g) for g in groups])
    flat = np.array([v for s in sets for v in sorted(s)], np.uint64)
    number = np.repeat(np.arange(len(groups)), members)
    want = [
        (x, y)
        for x in range(len(sets))
        for y in range(x)
        if number[x] == number[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])
    ]
    for shift in (0, 50):
        values = linking.apart(flat << np.uint64(shift), sizes, number)
        links, rest = linking.side_by_side(values, sizes, members, percent)
        assert not len(rest) and {(max(e), min(e)) for e in links.tolist()} <= set(want)
        assert union(len(sets), links.tolist()) == union(len(sets), want)


def test_large_groups_are_left_to_the_search_by_rarest():
    sizes, members = np.ones(linking.SMALL + 3, np.int64), np.array([2, linking.SMALL + 1])
    links, rest = linking.side_by_side(np.array([5, 5, *range(10, 11 + linking.SMALL)], np.uint64), sizes, members, 80)
    assert links.tolist() == [[0, 1]] and rest.tolist() == list(range(2, linking.SMALL + 3))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \t\nÄß", max_size=30), max_size=8))
def test_word_hashes(texts):
    docs = [t.encode() for t in texts]
    words = Words(docs, SPACES)
    assert [words.data[a:b] for a, b in zip(words.start, words.end)] == [w for d in docs for w in d.split()]
    assert np.diff(words.first).tolist() == [len(d.split()) for d in docs]
    sets = words.shingle_sets(2)
    assert [len(s) for s in sets] == [len(shingles_of(d, 2)) for d in docs]
    for x, s in zip(docs, sets):
        for y, t in zip(docs, sets):
            assert len(np.intersect1d(s, t)) == len(shingles_of(x, 2) & shingles_of(y, 2))


def shingles_of(data, width):
    words = tuple(data.split())
    return {words[i : i + width] for i in range(max(1, len(words) - width + 1))} if words else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=8))
def test_character_shingles(lines):
    values, sizes = char_shingle_sets(lines, 4)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    sets = [{x[i : i + 4] for i in range(max(1, len(x) - 3))} for x in lines]
    assert sizes.tolist() == [len(s) for s in sets]
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            got = set(values[begin[i] : begin[i + 1]].tolist()) & set(values[begin[j] : begin[j + 1]].tolist())
            assert len(got) == len(s & t)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_cuckoo_index_against_a_dict(steps):
    index, want = CuckooIndex(buckets=2), {}
    for step, (insert, k) in enumerate(steps):
        key = b"%02d" % (k % 7) + b"\0" * 8 + b"%04d" % k  # equal fingerprints, other contents
        if insert:
            index.absorb(key, step, 1)
            old = want.get(key, (step, 0))
            want[key] = (step, old[1] + 1)
        else:
            assert (index.delete(key) is not None) == (want.pop(key, None) is not None)
    assert {k: (i, n) for k, i, n in index} == want


def test_cuckoo_index_grows():
    index = CuckooIndex(buckets=1)
    keys = [random.Random(i).randbytes(32) for i in range(2000)]
    for i, k in enumerate(keys):
        index.absorb(k, i, 1)
    assert index.resizes > 5 and all(index.find(k) >= 0 for k in keys)
    assert index.find(b"\0" * 32) == -1


def test_index_of_live_digests(documents):
    first = documents({1: "a", 2: "b", 3: "B"})
    live = live_digests(first)
    after = updated(live, documents({7: "b", 8: "c"}), documents({1: "A"}))
    assert sorted((r.doc_id, r.copies) for r in after.collect()) == [(7, 3), (8, 1)]


def test_exact_groups(documents):
    texts = [random.Random(i).choice(["x", "X", "Ä", "ä", "y z", "y  z", ""]) for i in range(200)]
    lower = [t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    for r in exact_dedup(documents(enumerate(texts))).collect():
        same = [i for i, t in enumerate(lower) if t == lower[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))


def test_lines(documents):
    rng = random.Random(4)
    vocabulary = ["lorem", "ipsum", "dolor", "sit", "amet", "sed", "quia", "non"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 30))) for _ in range(25)] + ["}", "short"]

    def edited(line):
        at = rng.randrange(len(line))
        return rng.choice([line, line.upper(), line[:at] + "#" + line[at:], line[:at] + line[at + 1 :], line[at // 2 :]])

    texts = ["\n".join(rng.choice(["", edited(rng.choice(lines))]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    places, sets = [], []
    for d, t in enumerate(texts):
        for i, line in enumerate(t.split("\n")):
            words = b" ".join(line.encode().lower().split())
            if words:
                places.append((d, i))
                sets.append({words[k : k + 8] for k in range(max(1, len(words) - 7))})
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    gone = {places[i] for i, r in enumerate(union(len(sets), links)) if r != i}
    for row in line_dedup(documents(enumerate(texts))).collect():
        d = row.document.doc_id
        kept = [x for i, x in enumerate(texts[d].split("\n")) if (d, i) not in gone]
        assert row.document.text == "\n".join(kept)
        assert row.lines.n_removed == sum(g[0] == d for g in gone)


def line_components(docs):
    bands = groups_once(band_members(docs, 8))
    return lines_module.line_components(bands, line_places(docs, bands.select("id"), 8), 8, 80)


def test_a_chain_of_lines_whose_neighbours_alone_agree(documents):
    """A hundred thousand lines in one component: bands stay small, and no candidate cluster is formed."""
    rng = random.Random(17)
    words = [f"{rng.randrange(16**6):06x}" for _ in range(100_020)]
    lines = [" ".join(words[i : i + 20]) for i in range(100_000)]
    docs = documents((i, "\n".join(lines[at : at + 500])) for i, at in enumerate(range(0, len(lines), 500)))
    found = line_components(docs)
    assert found.count() == 100_000 and found.select("component").distinct().count() == 1


def test_lines_in_many_chunks(documents, monkeypatch):
    """Bands larger than a task may hold are dealt to chunks and lose no link."""
    monkeypatch.setattr(lines_module, "CHUNK", 400)
    rng = random.Random(6)
    base = " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet"], k=30))
    lines = [base[:at] + str(rng.randrange(10)) + base[at + 1 :] for at in range(0, len(base) - 1, 2)]
    docs = documents(enumerate(lines))
    found = line_components(docs)
    assert found.count() == len(set(lines)) and found.select("component").distinct().count() == 1


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), max_size=20), st.lists(st.integers(0, 20), max_size=4))
def test_bands_are_streamed_whatever_the_batches(rows, cuts):
    rows = sorted(rows)
    edges = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], pa.int64()) for i in (0, 1)], names=["key", "id"])
        for a, b in zip(edges, edges[1:])
    ]
    out = [tuple(r.values()) for b in shared_bands(iter(batches)) for r in b.to_pylist()]
    groups = {k: sorted({i for x, i in rows if x == k}) for k, _ in rows}
    members = [(k, i) for k, ids in groups.items() for i in ids if len(ids) > 1]
    assert sorted((k, i) for k, i, _, _ in out if i is not None) == sorted(members)
    ends = {k: (n, name) for k, i, n, name in out if i is None}
    assert {k: n for k, (n, _) in ends.items()} == {k: len(ids) for k, ids in groups.items() if len(ids) > 1}
    for k in ends:
        for j in ends:
            assert (ends[k] == ends[j]) == (groups[k] == groups[j])


@given(
    st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3)), max_size=30).map(lambda rows: sorted(rows, key=lambda r: r[0])),
    st.lists(st.integers(0, 30), max_size=4),
)
def test_keys_that_are_alone_are_left_out_whatever_the_batches(rows, cuts):
    edges = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    batches = [lines_module._key_rows(*(np.array([r[i] for r in rows[a:b]], np.int64) for i in (0, 1))) for a, b in zip(edges, edges[1:])]
    got = [tuple(r.values()) for batch in lines_module.not_alone(iter(batches)) for r in batch.to_pylist()]
    often = Counter(k for k, _ in rows)
    assert got == [r for r in rows if often[r[0]] > 1]


@given(st.lists(st.integers(0, (1 << 64) - 1)), st.lists(st.integers(0, (1 << 64) - 1)), st.integers(0, 2))
def test_held(known, asked, base):
    asked = asked + known[:3] + [0, 1]
    known = known + [base]
    got = held(np.array(known, np.uint64), np.array(asked, np.uint64))
    assert got.tolist() == [x in set(known) for x in asked]


def test_held_with_crowded_slots():
    rng = np.random.default_rng(5)
    known, asked = rng.integers(0, 5000, 3000, dtype=np.uint64), rng.integers(0, 5000, 9000, dtype=np.uint64)
    assert (held(known, asked) == np.isin(asked, known)).all()


def test_bands_are_sorted_by_one_number_first(documents):
    """Rows whose band nobody shares, nearly all, are not sorted by two columns."""
    docs = documents([(i, f"line number {i} of {i * 7919 % 1000} and more") for i in range(50)])
    plan = band_members(docs, lines_module.WIDTH)._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line.split("Sort ")[1].count("ASC") for line in plan.splitlines() if "Sort [" in line]
    assert sorts == [2, 1]  # the last one works on the rows that ``not_alone`` has left
