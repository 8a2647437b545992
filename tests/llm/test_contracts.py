"""Each query against its plain version, on the smallest dataset and on edge cases."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from brinewell.llm import queries as llm
from tests.llm import brute
from tests.llm.conftest import rows_of


def got(spark, name, sf, *cols):
    q = next(v for k, v in llm.QUERIES.items() if k.startswith(name + "_"))
    return sorted((tuple(r) for r in q(spark, sf).select(*cols).collect()), key=repr)


def docs_of(spark, sf):
    return rows_of(spark, sf, "documents", "doc_id", "text")


def test_op1(spark, sf):
    rows = {r[0]: r for r in got(spark, "op1", sf, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    want = {r[0]: r for r in brute.base_scores(docs_of(spark, sf))}
    assert rows.keys() == want.keys()
    for d, r in rows.items():
        assert r[:5] == want[d][:5]
        assert math.isclose(r[5], want[d][5], rel_tol=1e-9)
        assert r[6] < 0
    if "testdata" in sf:  # held-out texts: far below 8 bits a byte, though trained on 170 texts
        size = sum(len((t or "").encode()) for d, t in docs_of(spark, sf) if rows[d][1])
        assert sum(-r[6] for r in rows.values() if r[1]) / math.log10(2) / size < 2.9


def test_op2(spark, sf):
    items = rows_of(spark, sf, "benchmark", "item_id", "text")
    assert got(spark, "op2", sf, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.leaks(docs_of(spark, sf), items), key=repr)


def test_op3(spark, sf):
    rows = got(spark, "op3", sf, "page_id", "host", "path", "rule", "verdict")
    urls = dict(rows_of(spark, sf, "pages", "page_id", "url"))
    assert len(rows) == len(urls)
    for i, host, path, rule, verdict in rows:
        assert (host, path) == brute.host_path(urls[i])
        r, v = brute.rule_of(host, path)
        assert rule == r and verdict in ("allow", "block") and (v is None or verdict == v)


def test_op4(spark, sf):
    rows = got(spark, "op4", sf, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows == sorted(((d, *brute.base_quality(t)) for d, t in docs_of(spark, sf)), key=repr)
    assert all(not k for f, k in got(spark, "op4", sf, "base_failed", "kept") if f)


def test_op5(spark, sf):
    docs = rows_of(spark, sf, "documents", "doc_id", "source", "text")
    size = {d: len(brute.SPACE.findall(t or "")) for d, _, t in docs}
    source = {d: s for d, s, _ in docs}
    sizes = Counter()
    for d, s, _ in docs:
        sizes[s] += size[d]
    want = brute.targets(dict(sizes))
    rows = got(spark, "op5", sf, "doc_id", "size", "source_size", "target", "taken")
    taken = Counter()
    for d, n, m, t, k in rows:
        assert n == size[d] and m == sizes[source[d]] and math.isclose(t, want[source[d]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= k <= 2 * n
        taken[source[d]] += k
    assert len(rows) == len(docs)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    assert rows == got(spark, "op5", sf, "doc_id", "size", "source_size", "target", "taken")


def test_op6(spark, sf):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in docs_of(spark, sf)]
    assert got(spark, "op6", sf, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_op8(spark, sf):
    rows = got(spark, "op8", sf, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    want = {d: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs_of(spark, sf)}
    slots = defaultdict(list)
    for d, size, crc, law, shard, slot, grown in rows:
        assert (size, crc) == want[d] and law == "rows" and grown is None and 0 <= shard < 24
        slots[shard].append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(24)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(want)


def test_op9(spark, sf):
    assert got(spark, "op9", sf, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.removed(docs_of(spark, sf)), key=repr)


def test_op10(spark, sf):
    assert got(spark, "op10", sf, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs_of(spark, sf)), key=repr)


@pytest.mark.parametrize("name", sorted(llm.QUERIES))
def test_empty_tables(spark, empty, name):
    assert llm.QUERIES[name](spark, empty).collect() == []
