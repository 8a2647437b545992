"""Operators 11, 12 and 13: plain versions, and what their own interfaces promise."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brinewell.llm import merkle, resample, sentencepieces
from brinewell.llm.common import ordered
from tests.llm import brute
from tests.llm.conftest import EDGE_DOCS, rows_of
from tests.llm.test_contracts import docs_of, got

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A null id, rows that repeat, one id with two texts, a language of one document.
MORE = [*EDGE_DOCS, *EDGE_DOCS[:3], (None, "No Number", "en", "a", 9), (None, None, None, None, None), (1, "Another Text", "en", "a", 2), (77, "Alone", "zz", "a", 5)]


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_op11(spark, sf):
    rows = rows_of(spark, sf, "documents", "doc_id", "source", "lang", "n_chars", "text")
    assert got(spark, "op11", sf, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == by_repr(brute.merkle(rows))


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_paths_of_any_fanout(spark, fanout):
    df = spark.createDataFrame(MORE, DOCS)
    out = merkle.merkle_paths(df.withColumn("leaf", F.lit("mine")), fanout=fanout)  # a clashing column that isn't kept
    path = F.col("path")
    rows = out.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(path)), merkle.folded(F.col("leaf"), path)).collect()
    want = [(*r[:5], r[3]) for r in brute.merkle([(d, s, x, n, t) for d, t, x, s, n in MORE], fanout)]
    assert by_repr(rows) == by_repr(want)


def test_a_kept_column_may_not_be_called_like_an_output(spark):
    with pytest.raises(ValueError):
        merkle.merkle_paths(spark.createDataFrame(MORE, DOCS).withColumn("path", F.lit(1)), keep=("path",))


def test_no_two_rows_share_a_leaf_encoding(spark):
    rows = [(1, "ab", "c"), (2, "a", "bc"), (3, None, "ab"), (4, "-", "ab"), (5, "", None), (6, None, "")]
    leaves = spark.createDataFrame(rows, "id long, a string, b string").select(merkle.leaf_of(F.col("a"), F.col("b")).alias("h")).collect()
    assert len({r["h"] for r in leaves}) == len(rows)


def test_places_of_a_hot_group(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(F.col("id").cast("string")).alias("g"))
    found = {}
    for r in ordered(rows, "g", F.col("v").desc()).collect():
        found.setdefault(r["g"], []).append((r["_at"], r["v"], r["_of"]))
    assert sum(map(len, found.values())) == 3000 and len(found["hot"]) == 2000
    for x in found.values():
        x.sort()
        assert [a for a, _, _ in x] == list(range(len(x))) and {n for _, _, n in x} == {len(x)}
        assert [v for _, v, _ in x] == sorted((v for _, v, _ in x), reverse=True)


def test_op12(spark, sf):
    target = [t for (t,) in rows_of(spark, sf, "benchmark", "text")]
    want = [(d, f, w, s, r) for d, _, f, w, s, r in brute.resampled(docs_of(spark, sf), target)]
    assert got(spark, "op12", sf, "doc_id", "n_features", "weight", "score", "rank") == by_repr(want)


@pytest.mark.parametrize(("n", "size"), [(1, 40), (3, 40), (3, 1), (2, 1 << 18)])
def test_chunks_own_every_run_once(spark, n, size):
    df = spark.createDataFrame(MORE, DOCS).withColumns({"RANK": F.lit("mine"), "n_Words": F.lit("mine")})
    target = [("The quick brown fox",), (None,), ("w7 w14 w21 P1 p2",)]
    out = resample.resample(df, spark.createDataFrame(target, "text string"), n=n, size=size, buckets=50, least_words=3, percent=40)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_words", "n_features", "weight", "score", "rank"]
    want = brute.resampled([(r[0], r[1]) for r in MORE], [t for (t,) in target], n, 50, 3, 40)
    assert by_repr(out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == by_repr(want)
    drawn = {r[0] for r in want if r[5]} - {None}
    assert {r["doc_id"] for r in resample.drawn_rows(df, out).collect()} == drawn


def test_stretches_of_a_text_without_borders():
    assert list(resample.stretches(b"a" * 100, 10, 3)) == [(b"a" * 100, 100)]
    assert list(resample.stretches(b"", 10, 3)) == []
    assert list(resample.stretches(b"aa bb cc dd", 3, 2)) == [(b"aa bb cc", 5), (b" cc dd", 3), (b" dd", 3)]


def test_an_empty_target_or_table(spark):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    nothing = spark.createDataFrame([], "text string")
    assert [tuple(r)[1:3] for r in resample.resample(docs, nothing).select("doc_id", "n_features", "n_words").collect()] == [(3, 3)]
    assert resample.resample(docs.limit(0), nothing).collect() == []


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return sentencepieces.model(MODEL)


def agree(library, own, text):
    want = library.encode(text, add_bos=True, add_eos=True)
    packed = own.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want, text[:80]
    assert own.decode(packed) == library.decode(want)


def test_op13(spark, sf, library):
    import hashlib

    want = []
    for d, t in docs_of(spark, sf):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids))))
    assert got(spark, "op13", sf, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == by_repr(want)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=40), st.text("ab ▁\n", max_size=30), st.text("the and.,0éñ日本", max_size=30)))
def test_encoding_of_any_text(library, own, text):
    agree(library, own, text)


def test_encoding_of_joined_pieces_and_long_runs(library, own):
    r = random.Random(5)
    for _ in range(1500):
        agree(library, own, "".join(r.choice(own.pieces[259:]).replace("▁", " ") for _ in range(r.randint(1, 9))))
    for text in ("a" * 50_000, " " * 5_000, "".join(r.choices("abc", k=60_000)), "x \n" * 20_000, "▁" * 99 + "end", "\U0001f600" * 300):
        agree(library, own, text)


def test_stretches_and_memory_limits_change_nothing(library, own, monkeypatch):
    text = " ".join(f"word{i % 97} Straße, «x»" for i in range(400))
    for name, value in (("STRETCH", 17), ("REMEMBERED", 3), ("PAIRS", 2), ("LONGEST", 1)):
        monkeypatch.setattr(sentencepieces, name, value)
    agree(library, own, text)


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 258)), max_size=12))
def test_decoding_of_any_ids(library, own, ids):
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_pieces_interface(spark):
    df = spark.createDataFrame(MORE, DOCS).withColumns({"ids": F.lit("mine"), "Decoded": F.lit("mine")})
    out = sentencepieces.decode_pieces(sentencepieces.encode_pieces(df, MODEL), MODEL)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"])
    assert sorted(r["decoded"] for r in out.collect()) == sorted(r[1] or "" for r in MORE)
    nulls = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert by_repr(sentencepieces.decode_pieces(nulls, MODEL).select("decoded").collect()) == [("",), (None,)]


def test_other_kinds_of_models_are_refused(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[300], "type", 4)):
        other = pb.ModelProto()
        other.CopyFrom(proto)
        change(other)
        path = tmp_path / "other.model"
        path.write_bytes(other.SerializeToString())
        with pytest.raises(ValueError):
            sentencepieces.Model(str(path))
