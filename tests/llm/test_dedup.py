"""Suffix dedup and SimHash against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from entitylake.llm import common, components, near_copies, simhash, suffix_dedup, trie_join


def removed(docs, threshold=100):
    """(id, n_bytes, n_removed, n_spans, sha256) by looking at every window."""
    seen, out = set(), []
    for key, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - threshold + 1):
            window = data[s : s + threshold]
            if window in seen:
                gone[s : s + threshold] = b"\1" * threshold
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    para = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [para(r.randint(10, 80)) for _ in range(12)]
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1 and out:
            text = r.choice(out)[1]
        elif kind < 0.25 and out:
            parts = (r.choice(out)[1] or "").split(" ")
            for _ in range(r.randint(1, 4)):
                parts[r.randrange(len(parts))] = r.choice(words)
            text = " ".join(parts)
        elif kind < 0.3:
            text = "a" * r.randint(50, 700)
        elif kind < 0.35:
            text = ("ab c" * 200)[: r.randint(90, 600)]
        elif kind < 0.4:
            text = r.choice([None, "", "x" * 99, "x" * 100, "x" * 101])
        elif kind < 0.5:
            text = r.choice(shared)[:90] + para(r.randint(1, 9))  # a hot line that is too short to be a repeat
        else:
            text = " ".join([para(r.randint(1, 40)), r.choice(shared), para(r.randint(0, 10)), r.choice(shared)[r.randint(0, 30) :]])
        out.append((i, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_long_repeats(documents, seed):
    docs = corpus(seed, 250)
    mixed = random.Random(seed).sample(docs, len(docs))
    cut = suffix_dedup.dedup(documents(mixed, 5))
    found = cut.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, found)) == removed(docs)
    assert "row" in cut.select("rest.*").columns


def test_other_depths(documents):
    docs = corpus(3, 80)
    depth = suffix_dedup.Depth(threshold=37, ranges=3)
    found = suffix_dedup.dedup(documents(docs), depth=depth).select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, found.collect())) == removed(docs, 37)


def test_repeats_of_equal_and_missing_ids(documents, texts):
    assert suffix_dedup.dedup(documents([])).collect() == []
    long = texts[11]
    rows = suffix_dedup.dedup(documents([(1, long), (1, long), (2, long), (None, long)]))
    found = sorted((r.doc_id or 99, r.n_removed) for r in rows.select("rest.doc_id", "n_removed").collect())
    inside = removed([(0, long)])[0][2]
    assert found == [(1, inside), (1, inside), (2, len(long.encode())), (99, len(long.encode()))]


def test_cut_characters(documents):
    text = "é" * 60 + "".join(map(chr, range(0x100, 0x160)))
    rows = suffix_dedup.dedup(documents([(1, text), (2, "x" + text[:80])]), as_text=True).select("rest.doc_id", "kept")
    kept = {r.doc_id: r.kept for r in rows.collect()}
    assert all("�" not in t for t in kept.values()) and kept[2] == "x" and kept[1].startswith("éĀā")


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split() if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keys, budget):
    label = list(range(len(keys)))
    for i, a in enumerate(keys):
        for j in range(i):
            if bin(a ^ keys[j]).count("1") <= budget and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_near_duplicates(documents, texts, spark):
    r = random.Random(4)
    docs = list(enumerate(texts))
    for i in range(len(docs), 260):
        parts = (r.choice(docs)[1] or "q").split(" ")
        if len(parts) < 20_000:
            parts[r.randrange(len(parts))] = "changed"
        docs.append((i, " ".join(parts)))
    found = {r.doc_id: r for r in simhash.near_duplicates(documents(docs)).collect()}
    prints = [slow_fingerprint(t) for _, t in docs]
    assert [found[i].fingerprint for i, _ in docs] == [f"{p:016x}" for p in prints]
    assert [found[i].component_id for i, _ in docs] == slow_components(prints, 4)
    # Fixed value: Spark's own XXH64 of a text has the same seed.
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)
    kept = simhash.keep_one(documents(docs)).select("doc_id").collect()
    assert {k.doc_id for k in kept} == {i for i, _ in docs if found[i].component_id == i}


def test_near_duplicates_of_odd_tables(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    text = "one two three four five six"
    rows = simhash.near_duplicates(documents([(5, text), (5, text), (None, text), (None, "alone here"), (9, text)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 5)]


def test_one_document_of_each_group_stays_whatever_the_ids(documents):
    text, other, third = "one two three four five six", "quite unlike words of some length here", "a null id and nothing like it"
    rows = [(3, text), (5, text), (5, other), (7, third), (7, third), (None, text), (None, other + " too"), (None, other + " too"), (8, None), (8, "")]
    made = simhash.near_duplicates(documents(rows)).collect()
    assert len({r.fingerprint for r in made}) == 5
    assert {(r.doc_id, r.component_id) for r in made} == {(3, 3), (5, 3), (5, 5), (7, 7), (None, 3), (None, None), (8, 8)}
    kept = simhash.keep_one(documents(rows)).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 99, r.text or "") for r in kept) == [(3, text), (5, other), (7, third), (8, ""), (99, other + " too")]


def similarity(x, y):
    sets = []
    for text in (x, y):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_pipeline_drops_near_copies_and_keeps_the_rest(documents, spark):
    import corpus_pipeline

    r = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    docs, wanted, planted = [], set(), []
    for i in range(300):
        base = [r.choice(words) for _ in range(r.randint(80, 300))]
        docs.append((2 * i, " ".join(base)))
        wanted.add(2 * i)
        copy = list(base)
        for at in r.sample(range(len(copy)), r.randint(1, 3) if i % 3 else 9):
            copy[at] = "changed"
        like = similarity(docs[-1][1], " ".join(copy))
        docs.append((2 * i + 1, " ".join(copy)))
        if like < 0.8:
            wanted.add(2 * i + 1)
        else:
            planted.append((2 * i + 1, like))
    assert sum(like < 0.95 for _, like in planted) > 100 and len(wanted) > 330
    kept = {row.doc_id for row in corpus_pipeline.near_duplicates(spark, documents(docs), "").collect()}
    missed = [p for p in planted if p[0] in kept]
    assert kept == wanted and not missed


def test_a_bucket_of_unlike_texts(documents):
    """Thousands of texts that share a long line, and so fingerprints and shingles, but are no copies; each has one copy."""
    r = random.Random(2)
    line = " ".join(f"s{i}" for i in range(40))
    rows = []
    for i in range(1500):
        own = " ".join(r.choice("abcdefgh") + str(r.randrange(60)) for _ in range(40))
        rows += [(2 * i, f"{line} {own}"), (2 * i + 1, f"{line} {own} end")]
    kept = {row.doc_id for row in near_copies.keep_one(documents(rows)).collect()}
    assert kept == {2 * i for i in range(1500)}


def test_near_copies_of_odd_tables(documents):
    assert near_copies.keep_one(documents([])).collect() == []
    text = "one two three four five six"
    rows = [(5, text), (5, text), (None, text.upper()), (5, "alone here"), (9, text), (None, None), (None, " "), (None, "alone")]
    kept = near_copies.keep_one(documents(rows)).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 99, (r.text or "").strip()) for r in kept) == [(5, "alone here"), (5, text), (99, ""), (99, "alone")]


@pytest.mark.parametrize(("n", "bits"), [(1, 64), (300, 64), (400, 12), (700, 16)])
def test_trie_walk(n, bits):
    r = np.random.default_rng(n)
    keys = r.integers(0, 2**63, max(1, n // 5), dtype=np.uint64)[r.integers(0, max(1, n // 5), n)]
    for _ in range(5):
        keys ^= np.where(r.random(n) < 0.5, np.uint64(1) << r.integers(0, bits, n).astype(np.uint64), np.uint64(0))
    keys = np.unique(keys & np.uint64((1 << bits) - 1))
    starts = np.array(sorted({0, len(keys) // 3}))
    label = trie_join.components(keys, starts, np.ones(len(keys)), 4)
    wanted = []
    for s, e in zip(starts, [*starts[1:], len(keys)], strict=True):
        wanted += [s + x for x in slow_components([int(k) for k in keys[s:e]], 4)]
    assert list(label) == wanted


def test_dense_groups_are_walked_quickly():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 18, 150_000, dtype=np.uint64))
    assert (trie_join.components(keys, np.array([0]), np.ones(len(keys)), 4) == 0).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    label = {n: n for e in edges for n in e}
    for _ in range(80):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = components.labels(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in found} == {n: c for n, c in label.items() if n != c}
    assert components.labels(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_components_of_one_part_need_no_turn(spark, monkeypatch, tmp_path):
    """A chain and a star in one part are stars once written; over many parts and lots the result is the same."""
    made = []

    def folder(_, name):
        made.append(name)
        return str(tmp_path / f"{name}-{len(made)}")

    monkeypatch.setattr(common, "scratch_dir", folder)
    edges = [(i + 1, i) for i in range(300)] + [(1000, i) for i in range(1001, 1100)]
    wanted = {**{i + 1: 0 for i in range(300)}, **{i: 1000 for i in range(1001, 1100)}}
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.labels(table, "a", "b").collect()} == wanted
    assert len(made) == 1
    monkeypatch.setattr(components, "AT_ONCE", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = components.labels(table, "a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.node: r.component for r in rows} == wanted and len(rows) == len(wanted) and len(made) > 2
