"""Small inputs of the corpus operators: the smallest dataset, and one of edge cases."""

import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
EDGE_DOCS = [
    (1, "The quick brown fox\tjumps over\nthe lazy dog " * 6, "en", "a", 1),
    (2, "The quick brown fox\tjumps over\nthe lazy dog " * 6, "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \t\n ", "en", "b", 3),
    (6, LONG, "en", "b", len(LONG)),
    (7, LONG + " tail", "en", "b", len(LONG) + 5),
    (8, "one", "xx", "", 3),
    (9, "ONE", "xx", "c", 3),
    (10, f"intro words here {PASSAGE} and after", "de", "c", 1),
    (11, f"{PASSAGE} {PASSAGE}", "de", "c", 1),
    (12, "\u00c9t\u00e9 na\u00efve \U0001f600 caf\u00e9\x0b\x1cend\x85more\u00a0x" * 9, "fr", "d", 1),
    (13, "# * $ % & | < >\n# * $ % & | < >\n\n \n# * $", "fr", "d", 1),
    (14, "<|endoftext|> what is this, exactly? one two three four five six seven", "en", "\u00e9", 1),
]
EDGE_ITEMS = [(1, "quick BROWN fox jumps over the lazy dog the quick brown fox"), (2, "na\u00efve"), (10, None), (9, "..."), (None, "one two three"), (5, "what is this exactly one two three four five six")]
EDGE_PAGES = [
    (1, "HTTP://Sub.Example.COM/en/77?x=1", "<p>"),
    (2, "http://example.com/en/8#f", None),
    (3, None, None),
    (4, "no scheme", ""),
    (5, "https://a.net", ""),
    (6, "https://a.net/de/9", ""),
    (7, "https://a.net/de/9", ""),
    (8, "x://y.org?/es/", ""),
    (9, "x://notcom.xcom/en/", ""),
    (10, "http://u:p@h.co.uk:80/a://b", ""),
]


def write(spark, folder, docs=EDGE_DOCS, items=EDGE_ITEMS, pages=EDGE_PAGES):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    put("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", items, "item_id long, text string")
    put("pages", pages, "page_id long, url string, html string")
    put("labels", [(1, 1, 0), (2, 0, 1), (5, 0, 0), (6, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    return str(folder)


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.fixture(params=["small", "edge"])
def sf(request):
    return SF if request.param == "small" else request.getfixturevalue("edge")


def rows_of(spark, sf, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*cols).collect()]
