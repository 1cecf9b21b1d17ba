"""URL filters, quality rules, mixing, top-k search and sharding against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitylake.llm import mixing, quality, sharding, top_k, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", "/en/x", "block"), ("org", "/fr/", "allow")]
RULES += [("org", "/fr/a", "block"), ("org", "/", "block"), ("a.org", None, "allow"), ("", "/", "block"), (None, "/", "block")]


def slow_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [
        (h, p or "", v) for h, p, v in RULES
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "allow"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_filters(spark):
    r = random.Random(1)
    names = ["net", "example", "b", "org", "a", "com", "xnet", "NET", "É", "zz"]
    urls = [None, "", "no scheme", "://", "http://", "http://NET", "a://b://c.net/x", "http://a.net?x/en/", "http://x.net#/"]
    urls += ["https://" + ".".join(r.choices(names, k=r.randint(1, 4))) + r.choice(["", "/", "/en/x", "/fr/a?q", "/fr/", "/EN/"]) for _ in range(500)]
    rows = [(i, u, "c") for i, u in enumerate(urls)] + [(None, urls[20], "c"), (20, urls[20], "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for ranges, sample in ((1, 10), (7, 40), (16, 10_000)):
        found = url_filters.judge(pages, rules, ranges=ranges, sample_keys=sample).collect()
        assert Counter((x.id, x.host, x.path, x.rule, x.verdict) for x in found) == Counter((i, *slow_verdict(u)) for i, u, _ in rows)
    assert url_filters.judge(pages.limit(0), rules).collect() == []
    assert {x.rule for x in url_filters.judge(pages, rules.limit(0)).collect()} == {None}


def slow_stats(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 8))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def junk(r, i):
    words = "".join(r.choice("abcde ") for _ in range(r.randint(150, 900))).split()
    return " ".join(w + (r.choice(["%%%", "***"]) if i % 4 == 0 else "") for w in words)


def test_statistics(documents, texts):
    r = random.Random(2)
    odd = ["a b c d e f g h " * 9, "x\ny\nx\n \n\nx", "the same eight words are here again now " * 2 + "tail", "a " * 8]
    odd += [" ".join(r.choices("ab", k=r.randint(5, 60))) for _ in range(60)]
    rows = list(enumerate([*texts, *odd]))
    found = {x[0]: tuple(x[1:]) for x in quality.measure(documents(rows)).select("row.doc_id", *quality.STATS).collect()}
    assert found == {i: slow_stats(t) for i, t in rows}


def test_decision_list(documents, spark, texts):
    r = random.Random(3)
    rows = [(i, junk(r, i)) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(texts)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(300)] + [(1, None, 0), (2, 1, 0), (7, 0, 1), (9999, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(rows)
    found = {x.doc_id: x for x in quality.judge(docs, labels).collect()}
    for i, text in rows:
        n, *_, repeats = slow_stats(text)
        assert found[i].base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (found[i].base_failed and found[i].kept)
        if i < 400:
            # Held out are those from 300 on.
            assert found[i].kept == (i % 4 > 0 and not found[i].base_failed)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i in found if found[i].kept}
    for none in (labels.limit(0), labels.filter("quality = 1"), labels.filter("quality is null")):
        assert all(x.kept != x.base_failed for x in quality.judge(docs, none).collect())
    assert quality.judge(documents([]), labels).collect() == []


def test_columns_of_rules_hold_like_the_arrays(spark):
    rule = (quality.Condition("chars_per_word", True, 4.5), quality.Condition("words", False, 30.0))
    df = spark.createDataFrame([(25, 200, 0, 0, 0), (40, 400, 0, 0, 0), (25, 100, 0, 0, 0), (5, 50, 0, 0, 0)], [*quality.STATS])
    assert [x.k for x in df.select(quality.kept([rule]).alias("k")).collect()] == [False, True, True, False]


def slow_targets(sizes, weights):
    total, left = sum(sizes), dict(enumerate(sizes))
    target = {}
    while left:
        weight = sum(weights[i % len(weights)] for i in left)
        over = [i for i in left if (total - sum(target.values())) * weights[i % len(weights)] / weight > 3 * sizes[i]]
        if not over:
            share = total - sum(target.values())
            target |= {i: share * weights[i % len(weights)] / weight for i in left}
            break
        # Those above stop, the excess is shared again.
        first = min(over, key=lambda i: 3 * sizes[i] / weights[i % len(weights)])
        target[first] = 3 * sizes[first]
        del left[first]
    return [target[i] for i in range(len(sizes))]


def mixed(df):
    return [(x.doc_id, x.source, x.size, x.source_size, x.target, x.copies) for x in df.select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()]


@pytest.mark.parametrize("key", [None, 7])
def test_mixing_splits_equal_documents(documents, key):
    """Equal rows are taken one by one, so a source of them comes within a document of its target."""
    rows = [(key, "one two three four five six seven eight nine ten", "a") for _ in range(500)]
    rows += [(i, "w " * 10, "b") for i in range(1000, 1500)]
    out = mixing.mix(documents(rows, parts=7)).collect()
    for source in "ab":
        own = [r for r in out if r["row"]["source"] == source]
        assert len(own) == 500 and abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 10
        assert {r["copies"] for r in own} <= {0, 1, 2}


def test_mixing(documents):
    r = random.Random(4)
    sources = ["b", "a", "é", "Z", None, "tiny", "hot"]
    rows = [(i, " ".join("w" * r.randint(0, 60)), r.choices(sources, [5, 5, 5, 5, 5, 1, 40])[0]) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (None, "u v", "a"), (3, rows[3][1], rows[3][2])]
    docs = documents(rows, 5)
    found = mixed(mixing.mix(docs, buckets=16))
    assert sorted(found, key=str) == sorted(mixed(mixing.mix(docs.repartition(2), buckets=16)), key=str)
    assert sorted(found, key=str) == sorted(mixed(mixing.mix(docs, buckets=4096)), key=str)
    order = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len(WORD.findall(t or "")) for _, t, s in rows if s == name) for name in order]
    for name, size, target in zip(order, sizes, slow_targets(sizes, (1, 2, 3)), strict=True):
        own = [x for x in found if x[1] == name]
        assert all(x[3] == size and x[4] == pytest.approx(target) for x in own)
        assert all(0 <= x[5] <= 3 and abs(x[5] - target / max(size, 1)) < 1 or not x[2] for x in own)
        # Whole documents come as near as the smallest of them allows.
        assert abs(sum(x[2] * x[5] for x in own) - target) <= 30
    assert mixed(mixing.mix(documents([]))) == []


def slow_top(vectors, k):
    ints = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ints:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.normal(0, 0.15, 16)]) for i in range(300)]
    vectors += [(300 + i, vectors[0][1]) for i in range(60)]
    vectors += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 16), (460, [float("inf")] * 16), (480, []), (500, [0.5] * 3), (501, [-0.0] * 16)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string").repartition(4)
    for block, chunk in ((1000, 1000), (37, 5)):
        found = top_k.search(df, F.col("vec_id") % 20 == 0, k=7, block_rows=block, query_rows=chunk)
        assert sorted(map(tuple, found.collect())) == slow_top(vectors, 7)
    assert top_k.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = df.filter("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, top_k.search(few, F.col("vec_id") % 20 == 0).collect())) == slow_top(vectors[:3], 20)


def test_lists_are_left_early():
    """On isotropic vectors of 64 dimensions most queries stop before the last lists; results are those of all products."""
    r = np.random.default_rng(2)
    x = np.floor(64 * r.normal(0, 0.125, (4000, 64))).astype(np.int64)
    lists = top_k.Lists(x, np.arange(len(x)), int(np.abs(x).max()))
    early = 0
    for q in range(60):
        at, scores, read = top_k.aggregate(lists, x[q], q, 20)
        wanted = x @ x[q]
        wanted[q] = -(1 << 40)
        best = np.lexsort((np.arange(len(x)), -wanted))[:20]
        assert (at == best).all() and (scores == wanted[best]).all()
        early += read < 64
    assert early > 50
    huge = np.full((3, 2), 1 << 40)
    assert int(top_k.aggregate(top_k.Lists(huge, np.arange(3), 1 << 40), huge[0], 0, 1)[1][0]) == 1 << 81


def slow_shards(items, limit):
    out = {}

    def split(own, depth):
        if sum(n for _, n, _ in own) <= limit or depth == 60:
            out.update({i: f"{h >> (60 - depth):0{depth}b}" if depth else "" for h, _, i in own})
            return
        for bit in (0, 1):
            if part := [x for x in own if x[0] >> (59 - depth) & 1 == bit]:
                split(part, depth + 1)

    split(items, 0)
    return out


def test_sharding(documents, texts, spark):
    rows = list(enumerate(texts)) + [(100 + i, "same text") for i in range(200)] + [(None, "n")]
    docs = documents(rows)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5("t"))), 1, 15), 16, 10).cast("long"),
        F.octet_length("t"), "doc_id",
    )
    items = [tuple(x) for x in keyed.collect()]
    for limit, step in ((10**9, 16), (6000, 16), (6000, 3), (500, 7)):
        found = sharding.shard(docs, limit, step=step).select("row.*", "n_bytes", "shard", "depth", "shard_bytes", "oversized").collect()
        assert {x.doc_id: x.shard for x in found} == slow_shards(items, limit)
        total = Counter()
        for x in found:
            total[x.shard] += x.n_bytes
        assert all(x.shard_bytes == total[x.shard] and x.depth == len(x.shard) for x in found) and len(found) == len(rows)
        assert all(x.oversized == (x.shard_bytes > limit) and (not x.oversized or x.n_bytes > limit) for x in found)
    twins = sharding.shard(documents([(1, "x" * 60), (1, "x" * 60), (2, "y")]), 100).collect()
    assert sorted((x.row.doc_id, x.oversized) for x in twins) == [(1, True), (1, True), (2, False)]
    assert sharding.shard(documents([])).collect() == []


def test_written_shards(documents, tmp_path, spark):
    docs = documents([(i, "x" * i) for i in range(60)])
    sharded = sharding.shard(docs, 500)
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 60 and set(docs.columns) <= set(back.columns)
