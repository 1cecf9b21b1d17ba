"""Grouped prefix join, spelling variants and hard negatives against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylake.llm import components, gnat, negatives, prefix_join, shingle_sets, spellings
from test_dedup import corpus


def slow_set(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def slow_similar(rows, k, percent):
    """{place: (set size, least id of its component)} by looking at every pair that shares a shingle."""
    sets = [slow_set(text, k) for _, text in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)]


def found_similar(docs, **how):
    return [tuple(r) for r in prefix_join.components_of(docs, **how).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 3, 100)])
def test_similar_sets(documents, seed, k, percent):
    rows = corpus(seed, 150)
    assert in_order(found_similar(documents(rows), shingle=k, percent=percent)) == in_order(slow_similar(rows, k, percent))


def test_similar_odd_rows(documents, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[-1]), (3, texts[-2]), (3, "a b c"), (None, "only here at all"), (900, "A  b\tC")]
    assert in_order(found_similar(documents(rows))) == in_order(slow_similar(rows, 4, 85))
    assert found_similar(documents([])) == []


def test_chains_and_families(documents):
    """A chain whose ends are unlike, and a family of unlike texts that share half of their words."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    chain = [" ".join(f"x{i}" if i < 4 * step else w for i, w in enumerate(base)) for step in range(25)]
    shared = " ".join(f"s{i}" for i in range(60))
    family = [shared + " " + " ".join(r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(60)) for _ in range(400)]
    rows = list(enumerate(chain + family))
    found = found_similar(documents(rows))
    assert in_order(found) == in_order(slow_similar(rows, 4, 85))
    assert {c for i, _, c in found if i < len(chain)} == {0}


def test_links_are_few(documents):
    """A large family of near copies is joined without a row for every pair."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(600):
        words = list(base)
        words[r.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = documents(rows)
    links = prefix_join.links(docs, prefix_join.nodes_of(docs, 4, 85), 4, 85)
    assert links.count() < 30 * len(rows)
    assert components.labels(links, "a", "b").select("component").distinct().count() == 1


def test_filters_keep_what_is_similar():
    r = np.random.default_rng(3)
    for _ in range(200):
        s = np.unique(r.integers(0, 1 << 63, 80, dtype=np.uint64))
        t = np.unique(np.concatenate([s[r.random(len(s)) < 0.93], r.integers(0, 1 << 63, 5, dtype=np.uint64)]))
        apart = len(np.setxor1d(s, t))
        assert int(np.bitwise_count((prefix_join.bitmap(s) ^ prefix_join.bitmap(t)).view(np.uint64)).sum()) <= apart
    for n in range(1, 400):
        assert prefix_join.prefix_length(n, 85) == n - (85 * n + 99) // 100 + 1


def test_sketches_bound_the_difference_whatever_their_lengths():
    r = np.random.default_rng(5)
    for n, m, both in ((600, 600, 600), (600, 640, 500), (1000, 1100, 0), (5000, 4600, 4000), (300_000, 270_000, 260_000)):
        numbers = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64) * np.uint64(2)
        x, y = shingle_sets.sketch(numbers[:n], 512), shingle_sets.sketch(numbers[n - both :], 512)
        assert shingle_sets.apart(x, y) == shingle_sets.apart(y, x) <= n + m - 2 * both
        assert shingle_sets.apart(x, y) >= 0.6 * min(n + m - 2 * both, 4 * len(x))
    assert shingle_sets.sketch(numbers[:512], 512) is None


def test_unlike_long_texts_that_share_a_passage_meet_as_sketches_alone(documents):
    """Texts of 3000 words, too many for a bitmap of 512 bits; each shares 20 rare words with the next, and two are near copies."""
    r = random.Random(8)
    own = [[f"w{r.randint(0, 10**6)}" for _ in range(3000)] for _ in range(12)]
    for a, b in zip(own, own[1:], strict=False):
        b[:20] = a[-20:]
    rows = [(i, " ".join(words)) for i, words in enumerate(own)] + [(50, " ".join([*own[3][:2900], "x"])), (51, " ".join(own[7][300:]))]
    docs, held = documents(rows), []
    made = prefix_join.nodes_of(docs, 4, 85)
    whole = shingle_sets.similar

    def similar(pairs, sets, percent):
        held.extend((pairs.count(), sets.count()))
        return whole(pairs, sets, percent)

    shingle_sets.similar = similar
    try:
        assert prefix_join.links(docs, made, 4, 85).count() == 2
    finally:
        shingle_sets.similar = whole
    assert held == [2, 4]
    assert in_order(found_similar(docs)) == in_order(slow_similar(rows, 4, 85))


def test_shingles_tell_word_counts_apart():
    assert len(shingle_sets.shingles("a b c", 4)) == 1 and len(shingle_sets.shingles("", 4)) == 0
    assert shingle_sets.shingles("a b c", 4)[0] != shingle_sets.shingles("a b c d", 4)[0]
    assert (shingle_sets.shingles("A b\nC d e", 4) == shingle_sets.shingles("a b c D E", 4)).all()


# --- spellings ---


def slow_spellings(rows, every=97, letters=5, least=3):
    import re

    words = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if n >= least and len(w) >= letters}

    def edits(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    near = {w: [v for v in words if v != w and edits(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def found_spellings(docs, **how):
    rows = spellings.group_spellings(docs, **how).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in rows)


def misspelt(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéßÿ") for _ in range(r.randint(4, 9))) for _ in range(60)]

    def word():
        w = r.choice(base[: r.randint(1, 60)])
        while r.random() < 0.3:
            i, kind = r.randrange(len(w) + 1), r.randrange(3)
            w = w[:i] + (r.choice("abcdeéßÿ") if kind < 2 else "") + w[i + (kind > 0) :]
        return r.choice([w, w.upper(), w.title()]) if w else "x"

    return [(i, r.choice([" ", "1", "-", "漢"]).join(word() for _ in range(r.randint(0, 120)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_spellings(documents, seed):
    rows = misspelt(seed, 80)
    assert found_spellings(documents(rows)) == slow_spellings(rows)


def test_spellings_odd_rows(documents, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "hello hellp hello help hello hellp hellp"), (5, None), (5, "hello " * 9)] * 2
    assert found_spellings(documents(rows)) == slow_spellings(rows)
    assert found_spellings(documents(rows), letters=1, least=1) == slow_spellings(rows, letters=1, least=1)
    assert found_spellings(documents([])) == []


def test_chains_of_forms(documents):
    rows = [(0, " ".join(w for n, w in enumerate(["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]) for _ in range(3 * 2**n)))]
    found = {r[0]: r for r in found_spellings(documents(rows), every=1 << 40)}
    assert found["aaaaa"][1:3] == ("aaaab", "bbbbb") and found["bbbbb"][1:3] == ("", "bbbbb")


@pytest.mark.parametrize("letters", ["abc", "abcdefghijklmnopqrstuvwxyz"])
def test_signatures_meet(letters):
    r = random.Random(4)
    for _ in range(500):
        w = "".join(r.choice(letters) for _ in range(r.randint(1, 12)))
        i, kind = r.randrange(len(w)), r.randrange(3)
        v = w[:i] + (r.choice(letters) if kind < 2 else "") + w[i + (kind > 0) :]
        if v != w:
            assert set(spellings.signatures(w)) & set(spellings.signatures(v)), (w, v)


# --- hard negatives ---

VECTORS = "vec_id long, label int, embedding array<float>, id string, v string, q string, leaf string, cell string"


def slow_negatives(rows, is_anchor, positives=5, low=30, high=90, k=10):
    kept = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for key, lab, v in {(i, lab, tuple(v)) for i, lab, v in kept if is_anchor(i)}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), i, other == lab) for i, other, w in kept if i != key]
        for score, p, _ in sorted(s for s in scored if s[2])[:positives]:
            fit = sorted(s for s in scored if not s[2] and low * -score <= 100 * -s[0] <= high * -score)[:k]
            out += [(key, p, r + 1, i, -score, -s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out)


def vectors_of(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS)
    return df.repartition(parts) if rows else df


def clustered(seed, n, dims=8, labels=4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(labels * 3, dims))
    return [(i, int(c % labels), [float(x) for x in centers[c] + r.normal(size=dims) * 0.2]) for i, c in enumerate(r.integers(0, len(centers), n))]


@pytest.mark.parametrize(("seed", "sample_rows", "cell_rows"), [(1, 4096, 16_384), (2, 60, 50), (3, 200, 7)])
def test_negatives(spark, seed, sample_rows, cell_rows):
    rows = clustered(seed, 400)
    found = negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, F.col("label"), sample_rows=sample_rows, cell_rows=cell_rows)
    assert sorted(tuple(r) for r in found.collect()) == slow_negatives(rows, lambda i: i % 20 == 0)


def test_negatives_odd_rows(spark):
    same = [1.0, -0.5, 0.25]
    rows = [(0, 1, same), (0, 1, same), (0, 2, [0.1]), (1, 1, same), (2, 1, same), (3, 2, same), (4, 2, [0.8, 0.0, 0.1]), (4, 2, [0.8, 0.0, 0.1])]
    rows += [(5, None, same), (6, 1, None), (7, 1, [None, 1.0]), (8, 2, [float("nan")]), (None, 2, same), (20, 3, []), (21, 2, [0.0, 0.0, 0.0]), (40, 2, [float("inf")])]
    rows += [(50 + i, i % 3, [0.5, 0.1 * i, -0.2]) for i in range(12)]
    found = negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, F.col("label")).collect()
    assert sorted(tuple(r) for r in found) == slow_negatives(rows, lambda i: i % 20 == 0)
    assert negatives.mine(vectors_of(spark, []), F.lit(True), F.col("label")).collect() == []


def test_tree_eliminates_clusters(spark):
    """On clustered vectors most leaves are eliminated, and none that holds a row of the window."""
    rows = spark.createDataFrame([(i, lab, [int(256 * x) for x in v]) for i, lab, v in clustered(5, 3000, dims=6)], "id long, label long, v array<long>")
    index = gnat.build(rows, sample_rows=500)
    stored = index.rows.collect()
    x = np.array([r.v for r in stored])
    queries = x[:50]
    scores = queries @ x.T
    high = scores.max(axis=1)
    low = np.sort(scores, axis=1)[:, -20]
    reach = index.tree.reach(queries, np.arange(50), low.astype(float), high.astype(float))
    for i in range(50):
        for r, s in zip(stored, scores[i], strict=True):
            assert reach[i, r.leaf] or not low[i] <= s <= high[i]
    assert reach.mean() < 0.35
