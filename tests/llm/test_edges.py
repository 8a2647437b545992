"""Clashing columns, repeated rows, ties and splits of every operator's own interface."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brinewell.llm import decontam, hosts, mixing, neardup, permute, quality, sharding, substrings, tokens
from tests.llm import brute
from tests.llm.conftest import EDGE_DOCS

CLASH = ["n_words", "Size", "shard", "SLOT", "taken", "host", "kept", "n_hit", "n_tokens", "score", "removed", "component_id"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.createDataFrame(EDGE_DOCS + EDGE_DOCS[:2], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("mine") for c in CLASH})


def test_operators_replace_clashing_columns(spark, clashing):
    n = clashing.count()
    items = spark.createDataFrame([(1, "quick brown fox jumps")], "item_id long, text string")
    outs = [
        sharding.shard(clashing, 3), quality.judge_quality(clashing), quality.judge_quality(clashing, with_clean=True), decontam.find_leaks(clashing, items, with_clean=True),
        mixing.mix(clashing)[0], substrings.remove_repeats(clashing), neardup.near_duplicates(clashing),
    ]
    for df in outs:
        assert len({c.lower() for c in df.columns}) == len(df.columns)
        assert df.count() == n


def test_shards_do_not_depend_on_partitions(clashing):
    a = sorted(repr(tuple(r)) for r in sharding.shard(clashing.repartition(7), 5).collect())
    b = sorted(repr(tuple(r)) for r in sharding.shard(clashing.coalesce(1).orderBy("n_chars"), 5).collect())
    assert a == b


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(spark, n):
    a, b = permute.shape(n)
    assert a * b >= n
    got = [r["p"] for r in spark.range(n).select(permute.permuted("id", f"{n}L", f"{a}L", f"{b}L", "9L").alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_hot_line_is_removed_and_depleted_documents_go(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    common = " ".join(word() for _ in range(30))
    rows = [(i, "h", "\n".join([common, *(" ".join(word() for _ in range(12)) for _ in range(4))])) for i in range(80)] + [(i, "h", f"{common}\n{word()}") for i in range(80, 90)]
    rows += [(i, "other", f"{common} {word()}") for i in range(90, 100)]
    out = {x["doc_id"]: x for x in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, source string, text string"), line_docs=20, line_share=0.1, with_clean=True).collect()}
    assert all(out[i]["kept"] and common not in out[i]["clean_text"] for i in range(80))
    assert all(not out[i]["kept"] and not out[i]["base_failed"] for i in range(80, 90))
    assert all(out[i]["kept"] and out[i]["n_common_words"] == 0 for i in range(90, 100))


def test_whole_copies_are_not_boilerplate(spark):
    r = random.Random(2)
    text = "\n".join(" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(10)) for _ in range(5))
    out = quality.judge_quality(spark.createDataFrame([(i, "s", text) for i in range(100)], "doc_id long, source string, text string")).collect()
    assert all(x["kept"] for x in out)


def test_documents_of_boilerplate_only_are_depleted(spark):
    r = random.Random(3)
    line = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(6))
    template, notice = [line() for _ in range(10)], line() + " " + " ".join(str(i) for i in range(20))
    rows = [(i, "\n".join([*template, *(line() for _ in range(20))])) for i in range(200)] + [(200 + i, "\n".join([notice, *(line() for _ in range(20))])) for i in range(100)]
    rows += [(300, "\n".join(template)), (301, "\n".join([*template, line()])), (302, "\n".join([*template, line(), line()])), *((303 + i, notice) for i in range(50))]
    docs = spark.createDataFrame([(i, "s", t) for i, t in rows], "doc_id long, source string, text string")
    out = {x["doc_id"]: x for x in quality.judge_quality(docs).collect()}
    assert all(out[i]["kept"] for i in range(300))
    assert not any(out[i]["kept"] or out[i]["base_failed"] for i in range(300, 353))
    assert out[300]["n_common_words"] == 60 and out[302]["n_common_words"] == 60
    # whole copies move no verdict of others
    more = docs.union(docs.where("doc_id = 0").select(F.explode(F.expr("sequence(1000L, 3000L)")), "source", "text"))
    again = {x["doc_id"]: x for x in quality.judge_quality(more).collect()}
    assert all(again[i] == out[i] for i in out)


def test_a_line_in_many_documents_is_removed_on_any_host_size(spark):
    docs = spark.range(60_000).selectExpr("id doc_id", "'s' source", "concat(if(id < 500, 'follow us for more', concat('line ', id)), '\n', 'own ', id) text")
    out = quality.judge_quality(docs).where("n_common_words > 0").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("m"), F.max("n_common_words").alias("w")).first()
    assert tuple(out) == (500, 499, 4)


def test_reputation_follows_evidence(spark):
    rows = [(i, f"http://bad.spam.co.uk/{i}", 1) for i in range(40)] + [(100 + i, f"http://good.fine.com/{i}", 0) for i in range(40)] + [(200, "http://new.spam.co.uk/", None), (201, "http://once.fine.com/", 1), (202, None, None)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, bool(b)) for i, _, b in rows if b is not None], "page_id long, bad boolean")
    out = {r["page_id"]: r for r in hosts.judge_urls(pages, outcomes, rules=()).collect()}
    assert out[0]["verdict"] == "block" and out[100]["verdict"] == "allow" and out[201]["verdict"] == "allow" and out[202]["verdict"] == "allow"
    assert out[200]["bad_mean"] > out[201]["bad_mean"] - 0.5 and out[0]["bad_bound"] > out[200]["bad_bound"]


def test_leaks_in_parts_and_spans(spark):
    items = spark.createDataFrame([(i, f"alpha{i} beta gamma{i} delta epsilon zeta eta theta iota kappa{i} end") for i in range(30)], "item_id long, text string")
    text = "É Alpha3 BETA, gamma3-delta epsilon zeta eta theta iota KAPPA3! end. ünder"
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    whole = decontam.find_leaks(docs, items, with_clean=True).collect()
    parts = decontam.find_leaks(docs, items, max_item_bytes=1000, with_clean=True).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, parts))
    hit = next(r for r in whole if r["doc_id"] == 1)
    s = hit["leak_spans"][0]
    assert text.encode()[s["start"] : s["stop"]].decode() == "Alpha3 BETA, gamma3-delta epsilon zeta eta theta iota KAPPA3! end"
    assert hit["n_hit"] == 11 and hit["clean_text"] == "É . ünder"


def test_pieces_join_to_the_text():
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice(" \n\t 　\x1c\x85abc,.'1é") for _ in range(r.randrange(40)))
        assert "".join(tokens.pieces(t)) == t


def test_rounds_of_long_texts_count_as_the_whole(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(6)
    texts = ["".join(r.choice(" \n\t 　\x1c\x1f\x85abc,.'1é") for _ in range(r.randrange(900))) for _ in range(60)] + ["", "x" * 700, EDGE_DOCS[5][1]]
    monkeypatch.setattr(tokens, "ROUND_BYTES", 300)
    tokenizer, _ = tokens._tokenizer(path)
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tokens._lengths(path, pa.array(texts), np.array([len(t.encode()) for t in texts])) == want


def test_suffixes_from_a_table(spark):
    names = ["a.b.kawasaki.jp", "kawasaki.jp", "x.y.co.uk", "co.uk", "", "plain", "a." * 500 + "com"]
    table = spark.createDataFrame([(h,) for h in names], "host string")
    listed = spark.createDataFrame([("Kawasaki.jp",), ("b.kawasaki.jp",), ("co.uk",), ("co.uk",)], "suffix string")
    got = {r["host"]: (r["suffix"], r["domain"]) for r in hosts.registered(table, listed).collect()}
    assert got == {
        "a.b.kawasaki.jp": ("b.kawasaki.jp", "a.b.kawasaki.jp"), "kawasaki.jp": ("kawasaki.jp", "kawasaki.jp"), "x.y.co.uk": ("co.uk", "y.co.uk"),
        "co.uk": ("co.uk", "co.uk"), "": ("", ""), "plain": ("plain", "plain"), "a." * 500 + "com": ("com", "a.com"),
    }
    own = {r["host"]: (r["suffix"], r["domain"]) for r in hosts.registered(table).collect()}
    assert own["a.b.kawasaki.jp"] == ("jp", "kawasaki.jp") and own["x.y.co.uk"] == ("co.uk", "y.co.uk")


@pytest.mark.parametrize(("most", "bits"), [(3, 64), (3, 1 << 10), (40, 1 << 16), (10**9, 64)])
def test_routing_values_beyond_the_limit_change_nothing(spark, monkeypatch, most, bits):
    monkeypatch.setattr(substrings, "MOST", most)
    monkeypatch.setattr(substrings, "MAP_BITS", bits)
    r = random.Random(12)
    passage = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*(r.choice("abc") for _ in range(r.randrange(25))), *passage[r.randrange(4) :], *(r.choice("abc") for _ in range(r.randrange(25)))])) for i in range(60)]
    out = sorted((x["doc_id"], x["n_words"], x["n_removed"], brute.sha(x["kept_text"])) for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect())
    assert out == sorted(brute.removed(rows, 6))


def test_repeated_rows_and_repeated_lines_of_boilerplate_count_once_a_place(spark):
    notice = "all rights reserved by the owner"
    rows = [(i, f"{notice}\nown line number {i} of words " + " ".join(f"own{i}w{k}" for k in range(30)) + f"\n\t{notice}  \n", "s") for i in range(60)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string").withColumn("_k1", F.lit("mine"))
    for clean in (False, True):
        out = quality.judge_quality(docs, with_clean=clean).collect()
        assert len(out) == 65 and {(r["n_common_words"], r["kept"], r["_k1"]) for r in out} == {(12, True, "mine")}
    assert all(notice not in r["clean_text"] for r in out)


def test_large_groups_of_near_copies(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 700):
        w = list(base)
        w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"y{i}_{r.randrange(99)}" for _ in range(60))) for i in range(700, 720)]
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect())
    assert got == sorted(brute.near(rows, 2, 80))


def test_pairs_in_crowds_are_found(spark, monkeypatch):
    # at every level down to the last, fewer pairs at the limit are missed than 1 in 100,000
    assert all(neardup.missed(0.8, k) < 1e-5 for k in (3, 5, 7))
    monkeypatch.setattr(neardup, "SMALL", 2)
    r = random.Random(13)
    template, rows = [f"t{i}" for i in range(110)], []
    for pair in range(60):  # texts of one template, each near to one other only
        own = [f"p{pair}_{i}" for i in range(45)]
        rows += [(2 * pair + k, " ".join([*template, *own, *(f"o{pair}_{k}_{i}" for i in range(r.randrange(8, 15)))])) for k in range(2)]
    got = sorted(tuple(x) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect())
    assert got == sorted(brute.near(rows, 2, 80)) and sum(not x[3] for x in got) == 60


def test_repeats_match_brute_force_on_random_texts(spark):
    r = random.Random(11)
    rows = [(i if i % 9 else None, " ".join(r.choice("ab") for _ in range(r.randrange(60)))) for i in range(1, 60)]
    rows = [(d if d is not None else 1000 + i, t) for i, (d, t) in enumerate(rows)]
    out = sorted((x["doc_id"], x["n_words"], x["n_removed"], brute.sha(x["kept_text"])) for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect())
    assert out == sorted(brute.removed(rows, 6))


def test_mix_counts_are_spread_over_shards(spark):
    rows = [(i, f"s{i % 3}", " ".join(["w"] * 100)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    _, taken = mixing.mix(docs, block=10, shard_slots=500)
    per = defaultdict(int)
    for x in taken.groupBy("out_shard").agg(F.sum("_words").alias("n")).collect():
        per[x["out_shard"]] = x["n"]
    sizes = np.array([per[k] for k in sorted(per)][:-1])
    assert len(sizes) > 5 and (abs(sizes - sizes.mean()) < 0.1 * sizes.mean()).all()


def test_small_sources_reach_their_targets(spark):
    r = random.Random(21)
    rows = [(3 * i + k, f"s{i:03}", " ".join(["w"] * r.randrange(3, 60))) for i in range(300) for k in range(r.randrange(1, 4))] + [(5000 + i, "s000", " ".join(["w"] * 400)) for i in range(60)]
    mixed, taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    out = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert len(out) == 300 and all(abs(x["t"] - x["target"]) <= 0.5 + 1e-6 and x["most"] <= 2 for x in out)
    assert taken.agg(F.sum("_words")).first()[0] == sum(x["t"] for x in out)


def test_rules_have_the_contracts_verdicts(spark):
    urls = ["http://a.com/en/1", "http://www.example.com/en/70", "http://a.net/de/9", "http://www.example.net/de/80", "http://a.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    out = [tuple(r) for r in hosts.judge_urls(pages, outcomes).orderBy("page_id").select("rule", "verdict").collect()]
    assert out == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_texts_move_once_for_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(8))
    rows = [(i, f"a{i} b{i} {passage} c{i}", f"s{i}") for i in range(40)]
    rows += rows[:3]  # documents that stand in the table twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substrings.remove_repeats(docs, 6)
        got = sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"], x["t"]) for x in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted((i, 11, 8 if i else 0, f"a{i} b{i} c{i}" if i else rows[0][1], s) for i, _, s in rows)
    assert "ReusedExchange" in plan  # the texts' classes and their spans meet one exchange of the texts
