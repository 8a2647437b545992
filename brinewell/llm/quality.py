"""Operator 4: quality rules, by document and by the lines that documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.llm.common import SPACE, let, row_hash, without, words
from brinewell.session import cut

#: The symbols that count, and white space for translate().
SYMBOLS, BLANK = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: White space within a line that is more than a single blank.
WIDE = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
#: A line is boilerplate when more distinct contents of the host's documents hold it than LINE_DOCS and LINE_SHARE of all of them,
#: or than LINE_MOST whatever the host's size;
#: a document is depleted when fewer words than LEAST_WORDS, or less than LEAST_SHARE of them, are left.
LINE_DOCS, LINE_SHARE, LINE_MOST, LEAST_WORDS, LEAST_SHARE = 20, 0.01, 400, 20, 0.3
#: Parts that the rows of a very common line are dealt over.
SALT = 32


def _repeated(ws: Column, n: int) -> Column:
    """Words in n-word windows that the word list holds twice or more.

    Windows are first hashed: where all hashes differ, so do all windows. Only
    other lists are sorted with their windows' text, which decides exactly.
    """
    last = F.size(ws) - n + 1

    def exact(ws: Column) -> Column:
        keyed = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.struct(F.array_join(F.slice(ws, i, n), " ").alias("k"), i.alias("i"))))

        def covered(s: Column) -> Column:
            m = F.size(s)
            same = F.filter(
                F.transform(
                    F.sequence(F.lit(0), m - 1),
                    lambda j: F.when(((j > 0) & (F.get(s, j - 1)["k"] == F.get(s, j)["k"])) | (F.get(s, j + 1)["k"] == F.get(s, j)["k"]), F.get(s, j)["i"]),
                ),
                lambda i: i.isNotNull(),
            )
            return let(F.array_sort(same), lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, j: acc + F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(n)))))

        return let(keyed, covered)

    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(ws, i, n)))
    distinct = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(last < 2, F.lit(0)).when(distinct, F.lit(0)).otherwise(exact(ws))


def text_measures(text: Column, window: int = 8) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), all long; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANK, "")) > 0)
    return let(
        F.struct(t.alias("t"), words(t).alias("w"), lines.alias("l")),
        lambda s: F.struct(
            F.size(s["w"]).cast("long").alias("n_words"),
            F.length(F.translate(s["t"], BLANK, "")).cast("long").alias("word_chars"),
            (F.length(s["t"]) - F.length(F.translate(s["t"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
            let(s["w"], lambda w: _repeated(w, window)).cast("long").alias("n_repeat_words"),
        ),
    )


def normal_lines(text: Column) -> Column:
    """struct(h, n) of each line with a word: the hash of the lower-cased line with single blanks, and its words."""
    single = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WIDE, " ")
    norm = F.transform(F.split(single, "\n", -1), lambda x: F.trim(x))
    return F.transform(F.filter(norm, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def line_verdicts(lines: DataFrame, line_docs: int, line_share: float, line_most: int) -> DataFrame:
    """Per document key (_k1, _k2): _bad, the hashes of its boilerplate lines, and _words, the words in them; lines: _k1, _k2, _host, _lines.

    A host's distinct document contents are counted per line hash: documents
    with the same set of lines are one content, so whole copies of a document
    count once, in its lines' counts and in the host's size. They are made
    distinct and counted by partial aggregations before the shuffles. Lines in
    more contents than the limit are joined back in SALT parts, so one very
    common line doesn't land in one task.
    """
    contents = lines.select("_host", F.array_sort(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("_set")).distinct()
    counts = contents.select("_host", F.explode("_set").alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    size = contents.groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    limit = F.least(F.greatest(F.lit(float(line_docs)), F.col("_docs") * line_share), F.lit(float(line_most)))
    common = counts.where(F.col("_n") > min(line_docs, line_most)).join(size, "_host").where(F.col("_n") > limit).select("_host", "_line")
    salted = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    exploded = lines.select("_k1", "_k2", "_host", F.posexplode("_lines").alias("_at", "_l")).select("_k1", "_k2", "_host", "_at", F.col("_l.h").alias("_line"), F.col("_l.n").alias("_n"))
    held = exploded.withColumn("_salt", F.pmod("_k1", F.lit(SALT)).cast("int")).join(salted, ["_host", "_line", "_salt"])
    # a set of places: repeated rows have one key and the same lines
    found = held.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("_at", "_line", "_n")).alias("_gone"))
    return found.select("_k1", "_k2", F.array_distinct(F.transform("_gone", lambda x: x["_line"])).alias("_bad"), F.aggregate("_gone", F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_words"))


def judge_quality(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    least_words: int = LEAST_WORDS,
    least_share: float = LEAST_SHARE,
    with_clean: bool = False,
    line_most: int = LINE_MOST,
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_common_words, kept and, on request, clean_text.

    base_failed: fewer than 20 words, or more than 30 in 100 of them in 8-word
    windows that repeat. Beyond that a document is rejected as depleted when,
    without the lines that its host's documents share beyond the limits, fewer
    than least_words or less than least_share of its words are left. clean_text
    is the text without those lines, or the text as it is where none was found.

    A null text counts as empty and fails the base rules; null hosts form one
    host; repeated rows, and whole copies of a text, get the same verdict and
    count once; an empty table stays empty; texts are read whole; input columns
    called as an output are replaced. Measures and line hashes are written once;
    only clean_text reads the texts a second time.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_words", "kept", "clean_text")
    df = without(docs, *added)
    t = F.col("_t")
    host_key = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00none"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if with_clean or c != text])
    keyed = df.select(row.alias("_row"), F.col(f"`{text}`").alias("_t"), host_key.alias("_host"), row_hash(df, 41).alias("_k1"), row_hash(df, 42).alias("_k2"))
    if with_clean:
        base = keyed.select("_row", "_t", "_k1", "_k2", text_measures(t).alias("_m"))
        lines = cut(keyed.select("_k1", "_k2", "_host", normal_lines(t).alias("_lines")), "quality-lines")
    else:
        base = lines = cut(keyed.select("_row", "_k1", "_k2", "_host", text_measures(t).alias("_m"), normal_lines(t).alias("_lines")), "quality-lines")
        base = base.drop("_host", "_lines")
    j = base.join(line_verdicts(lines, line_docs, line_share, line_most), ["_k1", "_k2"], "left")
    j = j.withColumns({"_bad": F.coalesce("_bad", F.array().cast("array<bigint>")), "n_common_words": F.coalesce("_words", F.lit(0).cast("long"))})
    n = F.col("_m.n_words")
    failed = (n < 20) | (100 * F.col("_m.n_repeat_words") > 30 * n)
    left = n - F.col("n_common_words")
    depleted = (F.col("n_common_words") > 0) & ((left < least_words) | (left < n * least_share))
    out = j.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})
    new = [F.col(f"_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [F.col(c) for c in ("base_failed", "n_common_words", "kept")]
    if with_clean:
        norm = lambda x: F.xxhash64(F.trim(F.regexp_replace(F.lower(x), SPACE, " ")))
        cleaned = F.array_join(F.filter(F.split(t, "\n", -1), lambda x: ~F.array_contains("_bad", norm(x))), "\n")
        new.append(F.when(F.size("_bad") > 0, cleaned).otherwise(t).alias("clean_text"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if with_clean or c != text], *new)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's base measures and verdict; hosts are the documents' sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")
