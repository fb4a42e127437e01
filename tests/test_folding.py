"""Case folding against Python's on every code point, in both engines."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evidara.operators import audit as A
from evidara.operators import text as T
from evidara.plans import folding
from evidara.plans.views import DUCK, SPARK

WORDS = ["Ünïté ÀÉÎÖÞ ß µ", "Ünïté ÀÉÎÖÞß\n×÷ÿ", "ΟΔΟΣ", "οδοσ", "οδος", "5 µm", "5 μm", "ﬁne", "fine", "ſo", "so", "STRASSE", "straße", "ẞ", "İstanbul", "ŉ", "ᾈΙ", "ἀιι", "ᏸ", "Ᏸ", "𐐀𐐨", "Ǆ ǅ ǆ", "plain ASCII", "", "Σ Σ.", "aΣ", "😀Ⓐ"]


@pytest.fixture(scope="module")
def points(spark):
    """Every code point but surrogates, fifty to a row."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return ["x".join(every[i : i + 50]) for i in range(0, len(every), 50)]


def test_every_code_point(spark, points):
    texts = points + WORDS + [f"a{w}b {w}" for w in WORDS]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").repartition(4)
    df.createOrReplaceTempView("folding_texts")
    by_column = {r["i"]: r["y"] for r in df.select("i", folding.folded(F.col("x")).alias("y")).collect()}
    by_sql = {r["i"]: r["y"] for r in spark.sql(f"SELECT i, {folding.spark_sql('x')} AS y FROM folding_texts").collect()}
    con = duckdb.connect()
    by_duck = dict(con.execute(f"SELECT i, {folding.duck_sql('x')} FROM (SELECT unnest($i) AS i, unnest($x) AS x)", {"i": list(range(len(texts))), "x": texts}).fetchall())
    for i, x in enumerate(texts):
        assert by_column[i] == by_sql[i] == x.casefold(), (i, x)
        assert by_duck[i] == x.casefold(), (i, x)


def test_single_code_points(spark):
    """Alone, where no neighbour changes what ``lower`` does."""
    one, many = folding.foldings()
    texts = [*one, *many]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in texts], "x string").coalesce(1).select(folding.folded(F.col("x")).alias("y")).collect()]
    assert got == [x.casefold() for x in texts]


def test_leaks_of_folded_texts(spark):
    pairs = [("5 µm", "5 μm"), ("ﬁne", "fine"), ("ΟΔΟΣ", "οδοσ"), ("ſo", "so"), ("Straße", "STRASSE")]
    rows = [(f"{k}{s}", s, x) for k, pair in enumerate(pairs) for s, x in zip(("train", "test"), pair, strict=True)]
    s = spark.createDataFrame(rows, "sample_id string, split string, text string").withColumn("fingerprint", T.fingerprint(F.col("text")))
    found = A.duplicate_target_text(s).collect()
    assert sorted(r["sample_ids"] for r in found) == [[f"{k}test", f"{k}train"] for k in range(len(pairs))]


def test_tokens_and_views_fold_alike(spark):
    df = spark.createDataFrame([(x,) for x in WORDS], "x string")
    df.createOrReplaceTempView("folding_words")
    norm = [" ".join(x.casefold().split()) for x in WORDS]
    assert [r[0] for r in df.select(T.norm_split(F.col("x"))).collect()] == norm
    assert [r[0] for r in spark.sql(f"SELECT {SPARK['norm']('x')} FROM folding_words").collect()] == norm
    con = duckdb.connect()
    assert [r[0] for r in con.execute(f"SELECT {DUCK['norm']('x')} FROM (SELECT unnest($x) AS x)", {"x": WORDS}).fetchall()] == norm
    got = df.where("x = 'ΟΔΟΣ' or x = 'ﬁne'").select(T.tokens(F.col("x")).alias("t")).collect()
    assert sorted(r["t"] for r in got) == [["fine"], ["οδοσ"]]
