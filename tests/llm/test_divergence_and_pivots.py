"""The audit of sources and the clustering against plain whole-number versions."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import lineward.llm.divergence as divergence
from lineward.llm.divergence import shares, source_divergence, terms_of
from lineward.llm.pivots import cluster_vectors, distant, nearest, squared

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_divergence(docs, min_docs=10, top=10):
    in_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = Counter(TERM.findall((text or "").translate(LOWER)))
        in_docs[lang or ""].update(terms.keys())
        counts[lang or "", source or ""].update(terms)
    out = set()
    for lang in in_docs:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        groups = {s: {t: c[t] for t in kept} for (l, s), c in counts.items() if l == lang}

        def p(held):
            total = sum(held.values()) + 2 * len(kept)
            return {t: 1 + floor(Fraction(10**9 * (n + 2), total)) for t, n in held.items()}

        whole = p({t: sum(g[t] for g in groups.values()) for t in kept})
        by_source = {s: p(g) for s, g in groups.items()}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, mine in by_source.items():
            pair = {o: sum(f(mine[t], other[t]) for t in kept) for o, other in by_source.items() if o != s}
            term = {t: f(mine[t], whole[t]) for t in kept if groups[s][t] and mine[t] > whole[t]}
            for part, values, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, v, i) for i, (item, v) in enumerate(ranked, 1)}
    return out


def docs_of(spark, rows):
    schema = "lang string, source string, text string, term int, counts string, docs string, block string"
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], schema)


def some_docs(seed, n):
    rng = random.Random(seed)
    words = ["Of", "of", "été", "日本", "a1b", "x-y", "", "Zebra", "the", "\x00", "ÀB"]
    return [
        (rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "b", "ü", None, "B"]),
         rng.choice([None, " ".join(rng.choices(words, k=rng.randrange(9)))]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("spill, cells", [(96 << 20, 1 << 21), (500, 3)])
def test_divergence_equals_plain_counts(spark, monkeypatch, spill, cells):
    docs = [*some_docs(4, 260), ("xx", "alone", "rare words"), ("yy", "s", None), ("yy", "t", "!!!")]
    monkeypatch.setattr(divergence, "SPILL_BYTES", spill)
    monkeypatch.setattr(divergence, "DENSE_CELLS", cells)
    found = source_divergence(docs_of(spark, docs), 5, 3).collect()
    want = plain_divergence(docs, 5, 3)
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert ("yy", "s", "pair", "t", 0, 1) in want


def test_divergence_of_nothing(spark):
    assert source_divergence(docs_of(spark, [])).count() == 0


@given(st.text("aB z1é日\n", max_size=40), st.integers(1, 9))
@settings(deadline=None)
def test_terms_do_not_depend_on_pieces(text, size):
    before, divergence.PIECE_BYTES = divergence.PIECE_BYTES, size
    try:
        assert terms_of(text.encode()) == Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))
    finally:
        divergence.PIECE_BYTES = before


@given(st.lists(st.integers(0, 10**14), min_size=1, max_size=5), st.integers(0, 10**14))
def test_shares_are_exact(counts, more):
    total = max(counts) + more + 1
    found = shares(np.array(counts, np.int64), np.array([total], np.int64))
    assert found.tolist() == [1 + 10**9 * c // total for c in counts]


def plain_clusters(rows, rounds=3):
    vectors = [(i, [floor(Fraction(x) * 64) for x in v]) for i, v in rows]
    first = sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:16]
    centroids = [v for _, v in first]

    def assign():
        out = []
        for i, v in vectors:
            out.append((*min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)), i, v))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, k, _, v in assign():
            groups[k].append(v)
        for k, vs in groups.items():
            centroids[k] = [sum(column) // len(vs) for column in zip(*vs)]
    last = assign()
    inertia = Counter()
    for d, k, *_ in last:
        inertia[k] += d
    hashes = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i or 0), k, d, inertia[k], sum(inertia.values()), hashes[k]) for d, k, i, _ in last)


def vectors_of(spark, rows):
    schema = "vec_id long, embedding array<double>, cluster string, vector int, pivots string"
    return spark.createDataFrame([(*r, "c", 1, "p") for r in rows], schema)


@pytest.mark.parametrize("count", [1, 5, 90])
def test_clusters_equal_plain_ones(spark, count):
    rng = random.Random(count)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.gauss(0, 1)]) for _ in range(64)]) for i in range(count)]
    rows += [rows[0], (rows[0][0], [1.0] * 64), (None, [2.0] * 64), *[(500 + i, [0.125] * 64) for i in range(40)]]
    odd = [(901, None), (902, [1.0] * 63), (903, [1.0] * 65), (904, [1.0] * 63 + [None]), (None, None),
           (905, [float("nan")] + [0.0] * 63), (906, [float("-inf")] + [0.0] * 63), (907, [])]
    found = cluster_vectors(vectors_of(spark, rows + odd)).collect()
    assert sorted((r[0] or 0, *r[1:]) for r in found) == plain_clusters(rows)


def test_vectors_beyond_64_bits_end_with_an_error(spark):
    with pytest.raises(Exception, match="may not fit 64 bits"):
        cluster_vectors(vectors_of(spark, [(1, [1e9] * 64), (2, [0.0] * 64)])).collect()


def test_no_vectors(spark):
    assert cluster_vectors(vectors_of(spark, [])).count() == 0
    assert [r["cluster"] for r in cluster_vectors(vectors_of(spark, [(None, [1.0] * 64)])).collect()] == [0]


@given(st.integers(0, 10**6), st.sampled_from([1, 3, 1000, 1 << 26]))
@settings(deadline=None, max_examples=40)
def test_pruning_keeps_the_nearest_and_saves_distances(seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread + 1, (9, 64))
    vectors = centres[rng.integers(0, 9, 200)] + rng.integers(-1, 2, (200, 64))
    pivots = distant(vectors[:50], 16)
    distances = np.sqrt(squared(vectors, pivots).astype(float))
    cluster, distance, measured = nearest(vectors, distances, centres, pivots)
    every = squared(vectors, centres)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert spread < 1000 or measured <= 200 * 3
