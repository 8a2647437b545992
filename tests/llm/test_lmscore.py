"""The language model's parts: codes, tables and normalised predictions."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from brinewell.llm import lmscore as L


def test_code_is_complete():
    words = [b"\n", *(str(i).encode() for i in range(3000))]
    code = L.Code(words, [900, *(3000 // (i + 1) + 1 for i in range(3000))], 77)
    assert len(code.length) == len(words) + 1 and (code.length > 0).all()
    # each leaf's share under even predictions and the fixed rest of its path: no more than a whole
    total = 0.0
    for i in range(len(code.length)):
        total += 2.0 ** -(code.length[i] + code.rest[i])
    assert abs(total - 1) < 1e-6


def test_words_without_code_are_spelled_and_add_up():
    code = L.Code([b"\n", b"a"], [2, 5], 3)
    rng = np.random.default_rng(1)
    logit = rng.normal(0, 1, int(L.BASE[-1])).astype(np.float32)
    start = [L._start_weights(L.GATES, 3), L._start_weights(L.LETTER_GATES, len(L.LETTERS))]
    # all two-letter words over 256 letters, blank ends the word: the shares of one-letter words and their ends stay below 1
    letters = [bytes([b]) for b in range(256) if b not in b" \t\n\x0b\x0c\r" and not 65 <= b <= 90 and b != 97]
    _, cost = L.text_bits(code, logit, start, [[w] for w in letters])
    _, known = L.text_bits(code, logit, start, [[b"a"], []])
    assert sum(2.0**-c for c in [*cost, *known]) < 1


def test_blobs_round_trip():
    for n in ([], [1], [65535, 65536, 2**40, 3], list(range(1, 500))):
        n = np.array(n, np.int64)
        i = np.arange(0, 7 * len(n), 7)
        a, b = L.blob_values(L.blob_of(i, n))
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(i.tolist(), n.tolist(), strict=True))


def test_parts_of_a_batch_score_alike():
    import pyarrow as pa

    code = L.Code([b"\n", b"the", b"of"], [5, 9, 4], 20)
    rng = np.random.default_rng(2)
    logit = rng.normal(0, 1, int(L.BASE[-1])).astype(np.float32)
    start = [L._start_weights(L.GATES, 3), L._start_weights(L.LETTER_GATES, len(L.LETTERS))]
    texts = ["the cat of the house " * 400, "", None, "of", "x" * 5000]
    together = L.text_bits(code, logit, start, [L.tokens_of(t) for t in texts])[1]
    alone = [L.text_bits(code, logit, start, [L.tokens_of(t)])[1][0] for t in texts]
    assert np.allclose(together, alone)
    parts = list(L._parts(pa.array(texts)))
    assert list(itertools.chain.from_iterable(p for _, p in parts)) == [L.tokens_of(t) for t in texts]


def test_all_texts_held_out(spark):
    docs = spark.range(200).selectExpr("id doc_id", "'to be or not to be' text").where("crc32(cast(doc_id as string)) % 7 = 2")
    rows = L.score_texts(docs).collect()
    assert len(rows) > 10 and all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in rows)


def test_all_training_texts_are_counted_and_samples_leave_themselves_out(spark, monkeypatch):
    docs = [(i, f"alpha beta w{i % 7} gamma{i} " * (1 + i % 3)) for i in range(300)] + [(i, "hot text here") for i in range(300, 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    given, kept = [], []
    monkeypatch.setattr(L, "predictor_counts", lambda train, code, real=L.predictor_counts: given.append((train, code)) or real(train, code))
    monkeypatch.setattr(L, "fit_start", lambda *a, real=L.fit_start: kept.append(a) or real(*a))
    L.score_texts(df).count()
    assert given[0][0].count() == df.where(~L.held_out(df["doc_id"])).count()
    sample, slots, seen = kept[0]
    assert sum(copies for _, copies in sample) == given[0][0].count() and max(copies for _, copies in sample) > 50
    # the counts without a text are those of all other contents
    code = given[0][1].value
    text, copies = next((t, c) for t, c in L.fit_sample(given[0][0]) if c > 1)
    others = given[0][0].where(F.col("t") != text)
    logit, _ = L.slot_logits(((r["segment"], bytes(r["blob"])) for r in L.predictor_counts(others, given[0][1]).collect()), slots)
    b = L.Bits(code, [L.tokens_of(text)], learn=True)
    x, y = L.left_out(b, copies, slots, seen)
    assert np.allclose(x, np.stack([logit[a] for a in b.at], 1), atol=1e-5) and np.allclose(y, np.stack([logit[a] for a in b.lat], 1), atol=1e-5)


def test_short_texts_refine_their_weights():
    assert np.bincount(L.block_of(np.arange(1016))).tolist() == [8, 16, 32, 64, 128, 256, 256, 256]
    code = L.Code([b"\n", b"the", b"of"], [5, 9, 4], 20)
    logit = np.random.default_rng(3).normal(0, 1, int(L.BASE[-1])).astype(np.float32)
    start = [L._start_weights(L.GATES, 3), L._start_weights(L.LETTER_GATES, len(L.LETTERS))]
    once, twice = (L.text_bits(code, logit, start, [[b"the", b"word"] * n])[1][0] for n in (4, 60))
    assert twice < 14.5 * once  # later words of a text of 120 cost less


def test_stretches_of_a_long_text_score_as_the_whole(monkeypatch):
    code = L.Code([b"\n", b"the", b"of"], [5, 9, 4], 20)
    logit = np.random.default_rng(4).normal(0, 1, int(L.BASE[-1])).astype(np.float32)
    start = [L._start_weights(L.GATES, 3), L._start_weights(L.LETTER_GATES, len(L.LETTERS))]
    words = [[b"the", b"of", b"w%d" % (i % 17)][i % 3] for i in range(4000)]
    whole = L.text_bits(code, logit, start, [words])[1][0]
    tables = [np.bincount(np.concatenate([*b.at, *b.lat])) for b in L.stretches(code, [words], learn=True)]
    monkeypatch.setattr(L, "STRETCH", 512)
    parts, cost = L.text_bits(code, logit, start, [words])
    assert len(parts) > 5 and np.isclose(cost[0], whole, rtol=1e-6)
    assert sum(int(p.n[0]) for p in parts) == 4001 and [w for p in parts for w in p.flat] == [*words, L.END]
    again = sum(np.bincount(np.concatenate([*b.at, *b.lat]), minlength=len(tables[0])) for b in L.stretches(code, [words], learn=True))
    assert (again == tables[0]).all()


def test_letters_have_a_complete_code():
    steps, first, length = L._letter_code([b"there", b"here", b"where"])
    assert abs(sum(2.0 ** -int(n) for n in length) - 1) < 1e-12 and length[ord("e")] < length[ord("z")]
    assert len(set(map(bytes, (steps[a : a + n].tobytes() for a, n in zip(first, length, strict=True))))) == 256 and (steps >> 1).max() < 256


def test_paths_of_distinct_pairs_are_counted_as_all_decisions(monkeypatch):
    code = L.Code([b"\n", b"the", b"of", *(b"w%d" % i for i in range(40))], [90, 80, 60, *([3] * 20), *([1] * 20)], 70)
    rng = np.random.default_rng(5)
    texts = [[[b"the", b"of", b"w%d" % rng.integers(60)][rng.integers(3)] for _ in range(rng.integers(1, 900))] for _ in range(12)] + [[]]
    steps = []
    monkeypatch.setattr(L, "_steps", lambda *a, real=L._steps: steps.append(real(*a)) or steps[-1])
    for held, parts in ((10**9, [texts]), (700, [texts[:4], texts[4:]])):
        monkeypatch.setattr(L, "HELD", held)
        plain, met = np.zeros(2 * int(L.BASE[-1]), np.int64), L.Counts(code)
        for p in parts:
            b = L.Bits(code, p, learn=True)
            for at, bit in [(a, b.bit) for a in b.at] + [(a, b.lbit) for a in b.lat]:
                np.add.at(plain, 2 * at.astype(np.int64) + bit, 1)
        decisions = sum(map(len, steps))
        steps.clear()
        for p in parts:
            for t in L.stretches(code, p, True, L.Tokens):
                met.add(t)
        met.flush()
        assert (met.table == plain).all() and sum(map(len, steps)) < decisions
        steps.clear()


def test_first_weights_are_fitted_on_all_training_texts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(["the", "of", f"w{rng.integers(40)}", f"x{rng.integers(900)}"][rng.integers(4)] for _ in range(rng.integers(1, 120))) for _ in range(240)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(L, "NEAR", 1e-4)
    given, fits = [], []
    monkeypatch.setattr(L, "fit_all", lambda *a, real=L.fit_all: given.append(a) or fits.append(real(*a)) or fits[-1])
    for most in (400, 2, 0):
        monkeypatch.setattr(L, "FIT_DOCS", most)
        L.score_texts(df).count()
    # where the steps begin makes no difference
    assert not np.allclose(given[0][-1][0], given[1][-1][0], atol=0.01)
    for fit in fits[1:]:
        assert all(np.allclose(a, b, atol=2e-3) for a, b in zip(fits[0], fit, strict=True))
    # and they are those of all decisions of all training texts
    train, _, shared, blobs, _ = given[0]
    code, tables = shared.value, L.LeftOut(blobs).tables()
    plain = [L.Bits(code, [L.tokens_of(r["t"])], learn=True) for r in train.collect()]
    slots = np.unique(np.concatenate([L.slots_of(b) for b in plain]))
    seen = L.slot_logits(iter(blobs), slots)[1]
    x, y = (np.concatenate(c) for c in zip(*[L.one_out(b, slots, seen) for b in plain], strict=True))
    bit, row, lbit = (np.concatenate([getattr(b, c) for b in plain]) for c in ("bit", "row", "lbit"))
    of_tables = np.stack([tables[np.concatenate([b.at[k] for b in plain]) + bit.astype(int) * int(L.BASE[-1])] for k in range(3)], 1)
    assert np.allclose(x, of_tables, atol=1e-4)
    want = [L._fitted(x, bit, row % L.GATES, L.GATES), L._fitted(y, lbit, (y != 0).sum(1), L.LETTER_GATES)]
    assert all(np.allclose(a, b, atol=5e-3) for a, b in zip(fits[0], want, strict=True))


def test_slopes_of_distinct_contexts_are_those_of_all_decisions(monkeypatch):
    code = L.Code([b"\n", b"the", b"of", *(b"w%d" % i for i in range(300))], [90, 80, 60, *([3] * 200), *([1] * 100)], 70)
    rng = np.random.default_rng(7)
    texts = [[[b"the", b"of", b"w%d" % rng.integers(400)][rng.integers(3)] for _ in range(rng.integers(1, 900))] for _ in range(9)] + [[]]
    tables = rng.normal(0, 1, 2 * int(L.BASE[-1])).astype(np.float32)
    start = [rng.normal(0.3, 0.1, (L.GATES, 4)), rng.normal(0.2, 0.1, (L.LETTER_GATES, len(L.LETTERS) + 1))]
    b = L.Bits(code, texts, learn=True)
    want = []
    for at, bit, row, w in ((b.at, b.bit, b.row % L.GATES, start[0]), (b.lat, b.lbit, None, start[1])):
        x = np.stack([*(tables[a + bit.astype(int) * int(L.BASE[-1])] for a in at), np.ones(len(bit))]).astype(np.float64)
        row = (x[:-1] != 0).sum(0) if row is None else row
        p = 1 / (1 + np.exp(-(w[row].T * x).sum(0)))
        want.append(np.stack([np.vstack([(x[:, row == g] * (p * (1 - p))[row == g]) @ x[:, row == g].T, x[:, row == g] @ (p - bit)[row == g]]) for g in range(len(w))]))
    spelled = [w for t in texts for w in t if code.index.get(w, code.spelled) == code.spelled or code.shy[code.index[w]]]
    for held, parts in ((10**9, [texts]), (700, [texts[:4], texts[4:]])):
        monkeypatch.setattr(L, "HELD", held)
        got = L.Pulls(code, tables, start)
        for p in parts:
            for t in L.stretches(code, p, True, L.Tokens):
                got.add(t)
        words = sorted(set(spelled))
        got.spell(words, [spelled.count(w) for w in words])
        assert got.rows().num_rows == sum(s.size for s in got.sums)
        assert all(np.allclose(a, b, rtol=1e-3, atol=0.05) for a, b in zip(got.sums, want, strict=True))
