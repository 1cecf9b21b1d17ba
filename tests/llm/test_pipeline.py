"""The pipeline's stages, each on what the one before kept, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from entitylake.llm import common, near_copies, quality
from test_dedup import removed
from test_joins import slow_similar
from test_rows import slow_stats

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [common.table(spark, SF_DIR, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.stored(stage(spark, out[-1], SF_DIR), "stage"))
    return [df.collect() for df in out]


def test_columns(stages):
    for rows in stages[:-1]:
        assert set(rows[0].asDict()) == set(corpus_pipeline.COLUMNS)


def test_rules(stages, spark):
    before, after = stages[0], {r.doc_id for r in stages[1]}
    labels = {r.doc_id: r.quality for r in common.table(spark, SF_DIR, "labels").collect()}
    for r in before:
        n, *_, repeats = slow_stats(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            assert r.doc_id not in after
        elif labels.get(r.doc_id) == 1:
            assert r.doc_id in after


def test_near_duplicates(stages):
    before = sorted(stages[1], key=lambda r: r.doc_id)
    wanted = [key for key, _, component in slow_similar([(r.doc_id, r.text) for r in before], 5, 80) if component == key]
    assert sorted(r.doc_id for r in stages[2]) == wanted and len(wanted) < len(before)


def test_long_repeats(stages):
    before = sorted(stages[2], key=lambda r: r.doc_id)
    wanted = {i: (n, cut) for i, n, cut, *_ in removed([(r.doc_id, r.text) for r in before])}
    assert len(stages[3]) == len(before)
    for r in stages[3]:
        n, cut = wanted[r.doc_id]
        assert n - cut - 6 * (cut > 0) <= len(r.text.encode()) <= n - cut and r.n_chars == len(r.text)


def test_weights(stages):
    rows = {r.doc_id: r for r in stages[3]}
    taken = Counter(r.doc_id for r in stages[4])
    assert max(taken.values()) <= 3 and set(taken) <= set(rows)
    assert all(r == rows[r.doc_id] for r in stages[4])
    total, mix = sum(len(r.text.split()) for r in stages[3]), sum(len(r.text.split()) for r in stages[4])
    assert abs(total - mix) < 0.05 * total


def test_sequences(stages):
    docs = Counter(r.doc_id for r in stages[4])
    assert Counter(r.doc_id for r in stages[5] if r.piece == 0) == docs
    used = Counter()
    for r in stages[5]:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_stages_leave_no_texts_or_nodes_behind(documents, spark, monkeypatch, tmp_path):
    made = []

    def folder(_, name):
        made.append(tmp_path / f"{name}-{len(made)}")
        return str(made[-1])

    monkeypatch.setattr(common, "scratch_dir", folder)
    long = [" ".join(f"w{i * 7 + j}" for j in range(40)) for i in range(30)]
    docs = documents([*enumerate(long), (30, long[0]), (None, long[1]), (31, "few words"), (31, None)])
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    good = quality.keep_good(docs, labels)
    assert all(k != "string" for k in (t for at in made for _, t in spark.read.parquet(str(at)).dtypes))
    assert not any("row" in spark.read.parquet(str(at)).columns for at in made)
    assert sorted(r.doc_id is None or r.doc_id for r in good.collect()) == sorted([*range(31), True])
    one = near_copies.keep_one(good)
    assert not [at for at in made if at.name.startswith("shingle-nodes") and at.exists()]
    assert sorted(r.doc_id for r in one.collect()) == list(range(30))


def test_near_duplicates_are_few_jobs(documents, spark):
    """The driver holds something of every job and broadcast, whatever the rows: parts of few links take no turns of several plans."""
    long = [" ".join(f"w{i * 7 + j}" for j in range(60)) for i in range(40)]
    docs = documents([*enumerate(long), *((100 + i, t + " more") for i, t in enumerate(long))])
    spark.sparkContext.setJobGroup("near", "")
    try:
        rows = near_copies.keep_one(docs).collect()
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.doc_id for r in rows) == list(range(40))
    assert jobs < 165
