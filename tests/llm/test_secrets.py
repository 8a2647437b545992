"""Secret scans: candidates against a plain scan, held-out accuracy, and edge cases."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from brinewell.llm.secrets import CANDIDATE, EXAMPLES, FEATURES, HARMLESS, NAMES, SYMBOLS, dictionary, find_candidates, forest_score, made_findings, scan_secrets, transition_logs, with_features
from brinewell.session import cut
from tests.llm.brute import SPACE
from tests.llm.conftest import EDGE_DOCS, SF, rows_of

SCHEMA = "doc_id long, text string, at string, kept string"


def corpus(n=400):
    r, docs, truth = random.Random(3), [], []
    syllables = ["to", "ken", "ra", "ver", "mi", "con", "dal", "est", "or", "ina"]
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    common = [word(3) for _ in range(200)]
    for i in range(n):
        code = hashlib.sha1(str(i).encode()).hexdigest()
        kind = i % 4
        piece = [f'api_key = "{code}"', f"commit {code} merged", f"{word(4)}.{word(3)}@mail.example.com", r.choice(common).title() + r.choice(common).title() + r.choice(common).title()][kind]
        docs.append((i, " ".join(r.choices(common, k=30)) + f" {piece} " + " ".join(r.choices(common, k=20)), "x", "y"))
        truth.append((i, kind == 0))
    return docs, dict(truth)


def test_candidates_of_edge_texts(spark):
    docs = spark.createDataFrame([(d, t) for d, t, *_ in EDGE_DOCS] + [(20, "x token=\"A1b2C3d4E5f6G7h8\",also1234567890123456 y"), (None, "k 0123456789abcdef")], "doc_id long, text string")
    got = sorted((tuple(r) for r in find_candidates(docs, "text", "doc_id", None).select("doc_id", "at", "nth", "candidate", "before", "after").collect()), key=repr)
    want = []
    for d, t in [tuple(r) for r in docs.collect()]:
        for at, w in enumerate(SPACE.findall(t or "")):
            for nth, c in enumerate(re.findall(CANDIDATE, w)):
                if re.search("[0-9]", c) or re.search("[a-z].*[A-Z]", c) or re.search("[A-Za-z]{20}", c):
                    want.append((d, at, nth, c))
    assert [g[:4] for g in got] == sorted(want, key=repr) and len(want) >= 3
    assert (20, 1, 0, "A1b2C3d4E5f6G7h8", 'x token="', '",also1234567890123456 y') in got


def plain_context(t):
    """(at, nth, candidate, before, after) by the places of the matches in each word."""
    w = SPACE.findall(t or "")
    for at, word in enumerate(w):
        m = list(re.finditer(CANDIDATE, word))
        for n, x in enumerate(m):
            left = m[n - 2].end() if n >= 2 else 0
            right = m[n + 2].start() if n + 2 < len(m) else len(word)
            before, after = word[left : x.start()], word[x.end() : right]
            if n <= 1:
                before = " ".join(w[max(0, at - 3) : at]) + " " + before
            if n >= len(m) - 2:
                after = after + " " + (w[at + 1] if at + 1 < len(w) else "")
            yield at, n, x.group(), before, after


def test_neighbours_stand_where_the_match_does(spark):
    twice = 'see x=ABCDEFGHIJKLMNOP1;token="ABCDEFGHIJKLMNOP1" end'
    many = "a b " + ";".join(f"k{i}='{'q' * 15}{i % 3}'" for i in range(9)) + " c"
    inside = "xx ABCDEFGHIJKLMNOP1==ABCDEFGHIJKLMNOP1= =ABCDEFGHIJKLMNOP1=== 0123456789abcdef"
    texts = [twice, many, inside, "0123456789abcdef", "", None, twice]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["at"], r["nth"], r["candidate"], r["before"], r["after"]) for r in find_candidates(docs, "text", "doc_id", None).collect())
    assert got == sorted((d, *x) for d, t in enumerate(texts) for x in plain_context(t))
    assert [g[4] for g in got if g[0] == 0] == ["see x=", 'see x=ABCDEFGHIJKLMNOP1;token="']


def test_a_word_of_many_candidates_stays_linear(spark):
    n = 40_000
    docs = spark.createDataFrame([(1, ";".join(f"token={i:020d}" for i in range(n)))], "doc_id long, text string")
    r = find_candidates(docs, "text", "doc_id", None).agg(F.count(F.lit(1)), F.max(F.length("before") + F.length("after"))).first()
    assert r[0] == n and r[1] < 200


def plain_features(c, before, after, path, known, logs):
    """FEATURES of a candidate, written out."""
    side = len(SYMBOLS) + 1
    s = ["".join("0" if x in "0123456789" else x for x in c.lower())][0]
    place = lambda x: SYMBOLS.find(x) + 1
    steps = sum(logs[place(a) * side + place(b)] for a, b in zip(s, s[1:]))
    kinds = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", c)))
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    pieces = [w for w in re.split("[^a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", c).lower()) if len(w) >= 4 and w in known]
    share = lambda p: len(re.findall(p, c)) / len(c)
    b, p = before.lower(), (path or "").lower()
    has = lambda pattern, t: float(bool(re.search(pattern, t)))
    own = [float(len(c)), share("[0-9]"), share("[A-Z]"), share("[^A-Za-z0-9]"), len(set(c)) / len(c), changes / (len(c) - 1), has("^([0-9a-f]+|[0-9A-F]+)$", c), steps / (len(c) - 1), sum(map(len, pieces)) / len(c)]
    own += [float(c.count(x)) for x in "/.@"]
    return own + [has("://[^ ]*$", b), has(EXAMPLES, p), has(NAMES, b), has(HARMLESS, b), has("[=:] *[\"'`]?$", b), has("[\"'`]$", b) * has("^[\"'`]", after)]


def plain_score(trees, x):
    """A walk down each tree of the saved model."""
    total = 0.0
    for tree in trees:
        node = tree[0]
        while node["l"] >= 0:
            node = tree[node["l"] if x[node["f"]] <= node["t"] else node["r"]]
        total += node["p"]
    return total / len(trees)


def test_features_and_verdicts_against_plain_versions(spark):
    rows, _ = corpus(120)
    rows += [(900, 'see https://x.org/a/b?k=aB3dE5gH7jK9mN1pQ3 tests/token="ABCDEFGHIJKLMNOP1" x=ABCDEFGHIJKLMNOP1;token=\'ABCDEFGHIJKLMNOP1\'', None, "y"), (901, None, "x", "y"), (None, "key 0123456789ABCDEF0==", "tests/x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = cut(find_candidates(docs, "text", "doc_id", "at"), "t")
    known_df = cut(dictionary(docs, "text"), "t")
    runs = collections.Counter(w for _, t, *_ in rows for w in re.split("[^a-z]+", (t or "").lower()) if len(w) >= 4)
    known = {w: n for w, n in runs.items() if n >= 5}
    assert dict(map(tuple, known_df.collect())) == known
    side = len(SYMBOLS) + 1
    pairs = collections.Counter()
    for w, n in known.items():
        for a, b in zip(w, w[1:]):
            pairs[a + b] += n
    logs = []
    for a in range(side):
        row = [pairs.get(SYMBOLS[a - 1] + SYMBOLS[b - 1], 0) + 0.5 if a and b else 0.5 for b in range(side)]
        logs += [math.log(x / sum(row)) for x in row]
    got = with_features(found, known_df, transition_logs(known_df)).collect()
    assert len(got) >= 90
    for r in got:
        want = plain_features(r["candidate"], r["before"], r["after"], r["path"], known, logs)
        assert [r[f] for f in FEATURES] == pytest.approx(want, rel=1e-9), r

    made, truth = made_findings(spark, 600)
    judged = with_features(find_candidates(made, "text", "doc_id", None), known_df, logs).join(truth, "doc_id").withColumn("label", F.col("is_secret").cast("double"))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=5, maxDepth=4, seed=7, featuresCol="features", labelCol="label").fit(vector.transform(judged).select("features", "label"))
    trees = []
    for tree in forest.trees:
        def node(n, out):
            k = len(out)
            out.append(None)
            if n.numDescendants() == 0:
                stats = list(n.impurityStats().stats())
                out[k] = {"l": -1, "p": stats[1] / sum(stats)}
            else:
                left = node(n.leftChild(), out)
                right = node(n.rightChild(), out)
                out[k] = {"l": left, "r": right, "f": n.split().featureIndex(), "t": n.split().threshold()}
            return k
        nodes = []
        node(tree._call_java("rootNode"), nodes)
        trees.append(nodes)
    scored = with_features(found, known_df, logs).withColumn("score", forest_score(spark, forest)).collect()
    for r in scored:
        assert r["score"] == pytest.approx(plain_score(trees, [r[f] for f in FEATURES]), abs=1e-12)


def test_held_out_findings(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = find_candidates(docs, "text", "doc_id", None)
    kind = spark.createDataFrame(list(truth.items()), "doc_id long, is_secret boolean")
    labelled = found.where(F.col("doc_id") % 3 == 0).join(kind, "doc_id").select("doc_id", "at", "nth", "is_secret")
    out = scan_secrets(docs, labelled, train_rows=1000).where(F.col("doc_id") % 3 != 0).collect()
    right = sum(r["kept"] == truth[r["doc_id"]] for r in out)
    assert len(out) >= 150 and right >= 0.97 * len(out), (len(out), right)


def test_generated_findings_decide_without_labels(spark):
    docs, _ = corpus()
    out = scan_secrets(spark.createDataFrame(docs, SCHEMA)).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert {i for i in range(400) if i % 4 == 0} == kept


def test_generated_findings_held_out(spark):
    docs, truth = made_findings(spark, 1100)
    labelled = find_candidates(docs, "text", "doc_id", None).join(truth, "doc_id").select("doc_id", "at", "nth", "is_secret")
    want = {r["doc_id"]: r["is_secret"] for r in truth.collect()}
    out = scan_secrets(docs, labelled.where("doc_id % 5 < 2")).where("doc_id % 5 >= 2").collect()
    right = sum(r["kept"] == want[r["doc_id"]] for r in out)
    assert len(out) >= 500 and right >= 0.95 * len(out), (len(out), right)


def test_trees_as_expressions_equal_the_model(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Vectors

    r = random.Random(9)
    rows = [tuple(r.random() for _ in FEATURES) for _ in range(300)]
    df = spark.createDataFrame([(*x, float(x[0] + x[3] > 1)) for x in rows], ", ".join(f"{c} double" for c in (*FEATURES, "label"))).coalesce(1)
    v = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(v.transform(df))
    got = df.select(*FEATURES, forest_score(spark, forest).alias("a")).collect()
    own = [float(forest.predictProbability(Vectors.dense([x[c] for c in FEATURES]))[1]) for x in got]  # the model itself, without its UDF
    assert len({x["a"] for x in got}) > 3 and all(abs(x["a"] - b) < 1e-12 for x, b in zip(got, own, strict=True))


def test_one_kind_of_label_removes_nothing(spark):
    docs = spark.createDataFrame([(1, "mail a.person7@host.example.com now", "", "")] * 2, SCHEMA)
    out = scan_secrets(docs, spark.createDataFrame([(1, 1, 0, False)], "doc_id long, at long, nth int, is_secret boolean")).collect()
    assert len(out) == 2 and all(r["kept"] and r["secret_score"] is None for r in out)


def test_dataset(spark):
    from brinewell.llm.secrets import op7_secrets

    sf = SF.replace("0.001", "0.01")
    want = {d for d, t in rows_of(spark, sf, "documents", "doc_id", "text") if re.search(r'(?i)token = "[0-9a-f]{40}"', t or "")}
    assert {r["doc_id"] for r in op7_secrets(spark, sf).where("kept").collect()} == want
