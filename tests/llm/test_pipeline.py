"""The corpus pipeline, stage by stage, against plain versions."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from brinewell.session import cut
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, sf_module):
    docs, out = spark.read.parquet(f"{sf_module}/documents.parquet"), []
    out.append(docs)
    for name, f in P.STAGES:
        docs = cut(f(spark, docs, sf_module), name)
        out.append(docs)
    return out


@pytest.fixture(scope="module", params=["small", "edge"])
def sf_module(request):
    return "/root/testdata/sf0.001" if request.param == "small" else request.getfixturevalue("edge")


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_rules(stages):
    before, after = rows(stages[0]), {d: t for d, t, _ in rows(stages[1])}
    for d, t, _ in before:
        failed = brute.base_quality(t)[-1]
        assert (d in after) == (not failed) or d not in after  # none that fails is kept
    assert sum(d not in after and not brute.base_quality(t)[-1] for d, t, _ in before) <= 0.05 * len(before)
    lines = {d: Counter((t or "").split("\n")) for d, t, _ in before}
    assert all(not Counter(t.split("\n")) - lines[d] for d, t in after.items())  # only lines go


def test_near_duplicates(stages):
    before = rows(stages[1])
    want = {d for d, _, _, kept in brute.near([(d, t) for d, t, _ in before], 5, 80) if kept}
    assert {d for d, _, _ in rows(stages[2])} == want


def test_decontamination(spark, stages, sf_module):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_module}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0] for r in brute.leaks([(d, t) for d, t, _ in rows(stages[2])], items) if not r[-1]}
    assert {d for d, _, _ in rows(stages[3])} == want


def test_mix(stages):
    before, after = rows(stages[3]), rows(stages[4])
    texts, sizes, taken = {d: (brute.SPACE.findall(t or ""), s) for d, t, s in before}, Counter(), Counter()
    for w, s in texts.values():
        sizes[s] += len(w)
    per = Counter()
    for d, t, s in after:
        w, source = texts[d]
        got = brute.SPACE.findall(t)
        assert s == source and len(got) <= len(w)
        taken[s] += len(got)
        per[d] += len(got)
    for s, t in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 260
    assert all(per[d] <= 2 * len(texts[d][0]) for d in per)


def test_shards(stages):
    got = defaultdict(list)
    for r in stages[5].collect():
        got[r["shard"]].append(r["slot"])
    assert sum(map(len, got.values())) == stages[4].count()
    assert all(sorted(s) == list(range(len(s))) for s in got.values())
    counts = [len(got[k]) for k in range(P.SHARDS)]
    assert max(counts) - min(counts) <= 1


def test_empty(spark, empty):
    assert P.run(spark, empty).collect() == []


def test_rerun_agrees(spark, stages, sf_module):
    key = lambda df: sorted((repr(tuple(r)) for r in df.collect()))
    assert key(P.run(spark, sf_module)) == key(stages[5])
