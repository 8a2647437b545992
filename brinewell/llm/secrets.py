"""Operator 7: secret scans, with a random forest that removes false positives."""

from __future__ import annotations

import json
import uuid
from math import log

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.llm.common import let, without, words
from brinewell.session import cut, scratch_root

#: A candidate; the words that name secrets, and those that name harmless codes; folders of examples.
CANDIDATE = r"[A-Za-z0-9+/_.@-]{16,}={0,2}"
NAMES = r"(token|key|secret|passw(or)?d|pwd|auth|bearer|credential|signature)"
HARMLESS = r"(sha(1|256)?|md5|checksum|hash|commit|uuid|guid|digest|etag|version|example|sample|dummy|placeholder)"
EXAMPLES = r"(^|[/._-])(tests?|spec|examples?|samples?|fixtures?|docs?|mocks?)([/._-]|$)"
#: Letters in a dictionary word, and times that it stands in the corpus.
WORD_LETTERS, WORD_COUNT = 4, 5
#: Trees and their depth, rows of labelled findings that they are fitted on, and the probability from which a finding is kept.
TREES, DEPTH, TRAIN_ROWS, KEEP = 24, 6, 20_000, 0.5
#: Parts that the findings of one candidate are dealt over.
SALT = 8
#: Generated findings that the forest learns from where no judged ones are given.
MADE = 6_000
#: Symbols that transitions are counted between; all others are one more.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0"
FEATURES = ("length", "digits", "uppers", "symbols", "distinct", "changes", "runs_hex", "transitions", "coverage", "slashes", "dots", "ats", "in_url", "example_path", "named", "harmless", "assigned", "quoted")


def find_candidates(docs: DataFrame, text: str, doc_id: str, path: str | None) -> DataFrame:
    """(doc_id, path, at, nth, candidate, before, after): runs of 16 or more code characters with a digit, a capital inside, or 20 letters.

    at is the place of the word (from 0) that holds the candidate, nth its place
    among that word's candidates. before and after are what stands next to it:
    the characters up to the next candidate of its word, that candidate and
    the characters beyond it, and where the word begins or ends there, the three
    words before and the one after. So what a finding carries doesn't grow
    with the candidates of its word.
    """
    t = F.col(f"`{text}`")
    where = F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), where.alias("path"), t.alias("t")).where(F.col("t").rlike(CANDIDATE))

    def hits(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).rlike(CANDIDATE))
        near = lambda i: F.array_join(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), " ")
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.get(w, i).alias("w"), near(i).alias("b"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("a")))

    def each(h: Column) -> Column:
        """The candidates m of a word and the n + 1 gaps g around them, by their places."""
        last = F.size(h["m"]) - 1
        of = lambda k, i: F.coalesce(F.get(h[k], i), F.lit(""))
        head = lambda i: F.concat(of("g", i - 1), of("m", i - 1), of("g", i))
        tail = lambda i: F.concat(of("g", i + 1), of("m", i + 1), of("g", i + 2))
        before = lambda i: F.when(i <= 1, F.concat_ws(" ", h["b"], head(i))).otherwise(head(i))
        after = lambda i: F.when(i >= last - 1, F.concat_ws(" ", tail(i), h["a"])).otherwise(tail(i))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("nth"), F.get(h["m"], i).alias("candidate"), before(i).alias("before"), after(i).alias("after")))

    found = slim.select("doc_id", "path", F.explode(let(words(F.col("t")), hits)).alias("h"))
    parts = F.struct(F.regexp_extract_all("h.w", F.lit(CANDIDATE), 0).alias("m"), F.split("h.w", CANDIDATE, -1).alias("g"), F.col("h.b").alias("b"), F.col("h.a").alias("a"))
    out = found.select("doc_id", "path", F.col("h.at").alias("at"), F.explode(let(parts, each)).alias("x")).select("doc_id", "path", "at", "x.*")
    c = F.col("candidate")
    return out.where(c.rlike("[0-9]") | c.rlike("[a-z].*[A-Z]") | c.rlike("[A-Za-z]{20}"))


def dictionary(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): the corpus's words of WORD_LETTERS or more letters that it holds WORD_COUNT times or more."""
    runs = F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "[^a-z]+")
    every = docs.select(F.explode(F.filter(runs, lambda w: F.length(w) >= WORD_LETTERS)).alias("word"))
    return every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_COUNT)


def _symbol(c: Column) -> Column:
    return F.instr(F.lit(SYMBOLS), c)


def transition_logs(known: DataFrame) -> list[float]:
    """Log probabilities of one symbol after another within dictionary words, row by row; a table of len(SYMBOLS) + 1 squared."""
    side = len(SYMBOLS) + 1
    pairs = known.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))).alias("p"))
    counts = {r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()}  # 26 x 26 pairs at most
    table = []
    for a in range(side):
        row = [counts.get(SYMBOLS[a - 1] + SYMBOLS[b - 1], 0) + 0.5 if a and b else 0.5 for b in range(side)]
        table += [log(x / sum(row)) for x in row]
    return table


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def with_features(found: DataFrame, known: DataFrame, logs: list[float]) -> DataFrame:
    """found with its FEATURES; known: the dictionary; logs: its transitions. Candidates that many texts share are dealt over SALT parts."""
    c = F.col("candidate")
    plain = F.regexp_replace(F.lower(c), "[0-9]", "0")
    table = F.array(*[F.lit(x) for x in logs])
    side = len(SYMBOLS) + 1
    likely = let(F.struct(plain.alias("p"), table.alias("t")), lambda s: F.aggregate(F.sequence(F.lit(1), F.length(s["p"]) - 1), F.lit(0.0), lambda acc, i: acc + F.get(s["t"], _symbol(F.substr(s["p"], i, F.lit(1))) * side + _symbol(F.substr(s["p"], i + 1, F.lit(1))))))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    distinct = found.select("candidate").distinct()
    pieces = F.filter(F.split(F.lower(F.regexp_replace("candidate", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+"), lambda w: F.length(w) >= WORD_LETTERS)
    covered = distinct.select("candidate", F.explode(pieces).alias("word")).join(known, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    before, after, where = F.lower("before"), F.col("after"), F.lower(F.coalesce("path", F.lit("")))
    own = distinct.join(covered, "candidate", "left").select(
        "candidate",
        F.length(c).cast("double").alias("length"),
        _share(c, "[0-9]").alias("digits"),
        _share(c, "[A-Z]").alias("uppers"),
        _share(c, "[^A-Za-z0-9]").alias("symbols"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).alias("distinct"),
        ((F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / (F.length(c) - 1)).alias("changes"),
        c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("runs_hex"),
        (likely / (F.length(c) - 1)).alias("transitions"),
        (F.coalesce("covered", F.lit(0)) / F.length(c)).alias("coverage"),
        F.regexp_count(c, F.lit("/")).cast("double").alias("slashes"),
        F.regexp_count(c, F.lit("[.]")).cast("double").alias("dots"),
        F.regexp_count(c, F.lit("@")).cast("double").alias("ats"),
    )
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "at", "nth"), F.lit(SALT)).cast("int"))
    return dealt.join(own, ["candidate", "_salt"]).drop("_salt").withColumns(
        {
            "in_url": before.rlike("://[^ ]*$").cast("double"),
            "example_path": where.rlike(EXAMPLES).cast("double"),
            "named": before.rlike(NAMES).cast("double"),
            "harmless": before.rlike(HARMLESS).cast("double"),
            "assigned": before.rlike("[=:] *[\"'`]?$").cast("double"),
            "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        }
    )


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", path: str | None = None, train_rows: int = TRAIN_ROWS, keep: float = KEEP, seed: int = 7) -> DataFrame:
    """(doc_id, at, nth, candidate, secret_score, kept) of every candidate in every text.

    labelled(doc_id, at, nth, is_secret): judged findings; without it, generated
    ones (``made_findings``). A random forest of their features, fitted on
    train_rows of them at most (the first by a hash, half of either kind),
    scores every candidate; those below `keep` are false positives. If the
    judged findings are not of both kinds, nothing is removed and the score is
    null.

    Null and empty texts have no candidates; a null doc_id is carried along and
    matches no label; repeated rows give their findings each; a very long text
    or candidate is read whole; an empty table gives no rows; other columns
    don't matter.
    """
    found = cut(find_candidates(without(docs), text, doc_id, path), "secrets-found")
    known = cut(dictionary(docs, text), "secrets-words")
    logs = transition_logs(known)
    rows = cut(with_features(found, known, logs), "secrets-features")
    if labelled is None:
        made, truth = made_findings(docs.sparkSession)
        judged = with_features(cut(find_candidates(made, "text", "doc_id", None), "secrets-made"), known, logs).join(truth, "doc_id")
    else:
        judged = rows.join(labelled.select("doc_id", "at", "nth", "is_secret").distinct(), ["doc_id", "at", "nth"])
    judged = judged.where(F.col("is_secret").isNotNull()).select(*FEATURES, F.col("is_secret").cast("double").alias("label")).distinct()
    order = F.xxhash64(F.lit(seed), *FEATURES)
    sides = [judged.where(F.col("label") == k).orderBy(order, *FEATURES).limit(train_rows // 2) for k in (0, 1)]
    train = cut(sides[0].unionByName(sides[1]), "secrets-train")
    kinds = [r[0] for r in train.select("label").distinct().collect()]  # two values at most
    name = [F.col(c) for c in ("doc_id", "at", "nth", "candidate")]
    if len(kinds) < 2:
        return rows.select(*name, F.lit(None).cast("double").alias("secret_score"), F.lit(True).alias("kept"))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featuresCol="features", labelCol="label").fit(vector.transform(train).select("features", "label"))
    score = forest_score(docs.sparkSession, forest)
    return rows.withColumn("secret_score", score).select(*name, "secret_score", (F.col("secret_score") >= keep).alias("kept"))


def forest_score(spark: SparkSession, forest: RandomForestClassificationModel) -> Column:
    """The forest's probability of a secret as an expression over FEATURES: each tree's walk from its root, the leaves' shares averaged.

    The trees (TREES of 2 ** (DEPTH + 1) nodes at most) are read from the saved
    model and stand in the plan as one constant.
    """
    path = f"{scratch_root(spark)}/secrets-forest-{uuid.uuid4().hex}"
    forest.write().save(path)
    n = F.col("nodeData")
    share = F.when(F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x) > 0, n["impurityStats"][1] / F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", n["id"].alias("id"), n["split"]["featureIndex"].alias("f"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("t"), n["leftChild"].alias("l"), n["rightChild"].alias("r"), share.alias("p"))
    trees: dict[int, dict[str, list]] = {}
    for row in nodes.orderBy("treeID", "id").collect():  # bounded, see above
        tree = trees.setdefault(row["treeID"], {k: [] for k in "ftlrp"})
        for k in "ftlrp":
            tree[k].append(row[k])
    table = F.from_json(F.lit(json.dumps(list(trees.values()))), "array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,p:array<double>>>")
    x = F.array(*[F.col(c).cast("double") for c in FEATURES])

    def leaf(tree: Column, x: Column) -> Column:
        step = lambda at, _: F.when(F.get(tree["l"], at) < 0, at).when(F.get(x, F.get(tree["f"], at)) <= F.get(tree["t"], at), F.get(tree["l"], at)).otherwise(F.get(tree["r"], at))
        return F.get(tree["p"], F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step))

    return let(F.struct(x.alias("x"), table.alias("trees")), lambda s: F.aggregate(s["trees"], F.lit(0.0), lambda acc, tree: acc + leaf(tree, s["x"])) / F.size(s["trees"]))


def made_findings(spark: SparkSession, n: int = MADE, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(docs, labels): n generated texts with one judged finding each, of twelve kinds in turn.

    Secrets: hexadecimal and mixed-case codes given to a name such as token,
    api_key or password, quoted or not, and connection strings. False ones:
    checksums, commits, unique ids, numbers, addresses, file paths, joined
    words, links and placeholders. Codes come from hashes of the row's number.
    """
    hexa = F.sha2(F.concat_ws("/", F.lit(seed), "id"), 256)
    mixed = F.translate(F.base64(F.unhex(hexa)), "=", "")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(xs))) + 1).cast("int"))
    given = pick("token", "api_key", "secret", "password", "auth_key", "access_token", "client_secret", "signature_key")
    ties = pick(' = "', "=", ': "', ' = ', ":'", '="')
    word = pick("release", "market", "station", "window", "garden", "letter", "number", "summer", "bridge", "doctor")
    other = F.element_at(F.array(*[F.lit(x) for x in ("Manager", "Service", "Handler", "Builder", "Weather", "Planner", "Archive")]), (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(7)) + 1).cast("int"))
    size = lambda lo, hi: (F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(hi - lo)) + lo).cast("int")
    quote = F.when(ties.contains('"'), '"').when(ties.contains("'"), "'").otherwise("")
    kinds = [
        (True, F.concat(given, ties, F.substr(hexa, F.lit(1), size(20, 64)), quote)),
        (True, F.concat(given, ties, F.substr(mixed, F.lit(1), size(18, 40)), quote)),
        (True, F.concat(F.upper(given), F.lit("="), F.substr(mixed, F.lit(1), size(18, 40)))),
        (True, F.concat(F.lit("authorization: bearer "), F.substr(mixed, F.lit(1), size(24, 40)))),
        (False, F.concat(pick("commit ", "sha256: ", "checksum ", "md5 = ", 'etag="', "digest:"), F.substr(hexa, F.lit(1), pick(40, 64, 32)))),
        (False, F.concat(given, pick(" commit ", " checksum ", " of commit ", " sha1 "), F.substr(hexa, F.lit(1), pick(40, 40, 64, 32)))),
        (False, F.concat(pick("uuid ", "request ", "row id: ", "guid="), F.regexp_replace(F.substr(hexa, F.lit(1), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))),
        (False, F.concat(pick("call ", "order no ", "on ", "ref: "), F.translate(F.substr(hexa, F.lit(1), size(17, 24)), "abcdef", "012345"))),
        (False, F.concat(pick("mail ", "from: ", "<"), word, F.lit("."), F.lower(other), (F.col("id") % 97).cast("string"), F.lit("@mail.example.com"))),
        (False, F.concat(pick("see https://", "in /usr/share/", "open src/main/"), word, F.lit("s/"), F.lower(other), F.lit("/"), word, (F.col("id") % 89).cast("string"), pick(".html", ".java", ".txt"))),
        (False, F.concat(pick("class ", "the ", "calls ", "new "), F.initcap(word), other, F.initcap(word), (F.col("id") % 9).cast("string"))),
        (False, F.concat(given, ties, pick("your-secret-goes-here-1", "example-token-0000000000", "xxxxxxxxxxxxxxxxxxxx0", "placeholder.value.here.1"), quote)),
    ]
    i = F.col("id") % len(kinds)
    text = F.coalesce(*[F.when(i == k, F.concat(word, F.lit(" and then "), t, F.lit(" was "), F.lower(other))) for k, (_, t) in enumerate(kinds)])
    made = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), i.isin([k for k, (secret, _) in enumerate(kinds) if secret]).alias("is_secret"))
    return made.select("doc_id", "text"), made.select("doc_id", "is_secret")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document, its score and whether it is kept; documents' sources stand for paths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return scan_secrets(docs, path="source")
