"""Golden values of the text metrics, and the word distance against a plain table."""

import random

import pytest
from pyspark.sql import functions as F

from evidara.operators import text as T


def preds(spark, rows):
    return spark.createDataFrame([("r", "full", str(i), h, r) for i, (h, r) in enumerate(rows)], "run_id string, control string, sample_id string, prediction_text string, reference_text string")


def one(df, column):
    return df.select(column).first()[0]


def test_edit_distances(spark):
    p = preds(spark, [("flaw", "lawns")])
    assert one(p.select(T.char_distance(F.col("prediction_text"), F.col("reference_text")).alias("d")), "d") == 3
    r = T.corpus_error_rate(preds(spark, [("The quick borwn fox", "the  quick brown fox")])).first()
    assert r["cer"] == pytest.approx(2 / 19)


def test_word_distance_is_the_plain_one(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "dd", "é"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 7))), " ".join(rng.choices(words, k=rng.randint(0, 7)))) for _ in range(60)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = preds(spark, rows).select("prediction_text", "reference_text", T.word_distance(F.col("prediction_text"), F.col("reference_text")).alias("d"), T.word_edit_ops(T.metric_words(F.col("prediction_text")), T.metric_words(F.col("reference_text"))).alias("o")).collect()
    for h, r, d, o in got:
        assert d == plain(h.split(), r.split()) == sum(o)


def test_similarity_golden(spark):
    assert one(T.corpus_bleu(preds(spark, [("one two three", "one two three")])), "bleu") == pytest.approx(1.0)
    assert one(T.corpus_bleu(preds(spark, [("four five", "one two three")])), "bleu") == 0.0
    assert one(T.meteor_unigram(preds(spark, [("a b", "a b")])), "meteor") == pytest.approx(0.9375)
    p = preds(spark, [("a c", "a b c"), ("", ""), ("a", "")])
    got = [x[0] for x in p.orderBy("sample_id").select(T.rouge_l_f1(T.metric_words(F.col("prediction_text")), T.metric_words(F.col("reference_text")))).collect()]
    assert got == pytest.approx([0.8, 1.0, 0.0])


def test_error_categories(spark):
    rows = [("a b", "a b"), ("", "a"), ("x", "a b"), ("a a b", "a b"), ("a", "a b"), ("a b c", "a b"), ("a x", "a b"), ("", "")]
    got = {r["sample_id"]: r["category"] for r in T.error_categories(preds(spark, rows)).collect()}
    assert [got[str(i)] for i in range(len(rows))] == ["exact", "empty", "hallucination", "repetition", "omission", "hallucination", "substitution", "empty"]
    s = {r["category"]: r["n"] for r in T.taxonomy_summary(T.error_categories(preds(spark, rows))).collect()}
    assert s["empty"] == 2 and len(s) == 6


def test_vocabulary_order_and_round_trip(spark):
    s = spark.createDataFrame([("1", "train", "Red fish, blue fish."), ("2", "train", "blue boat"), ("3", "test", "green fish")], "sample_id string, split string, text string")
    v = T.vocabulary(s)
    assert [r["token"] for r in v.orderBy("token_id").collect()] == ["blue", "fish", ",", ".", "boat", "red"]
    e = T.encoded(s, v)
    assert [r["token_id"] for r in e.where("sample_id = '3'").orderBy("pos").collect()] == [1, 3, 5, 2]
    d = {r[0]: r[1] for r in T.decoded(e, v).collect()}
    assert d["1"] == "red fish, blue fish."
    assert [tuple(r) for r in T.unknown_tokens(s.where("split = 'test'"), v).collect()] == [("3", "green", 1)]
    assert T.encoded(s.where("split = 'train'"), v, unknown="error").count() == 12
    with pytest.raises(Exception, match="green"):
        T.encoded(s, v, unknown="error").collect()


def test_metric_normaliser_folds_compatibility_forms(spark):
    t = spark.createDataFrame([("ﬁ Ａ ß",), ("Plain  Text",), (None,)], "t string").select(T.norm_metric(F.col("t")).alias("n"))
    assert [r[0] for r in t.collect()] == ["fi a ss", "plain text", None]


#: A ligature, full-width letters, a decomposed letter and a superscript, and what they are compared with.
COMPATIBLE = [("ﬁne Ｗord", "fine word"), ("cafe\u0301 au lait", "café au lait"), ("x² grows", "x2 grows"), ("STRASSE", "Straße")]


def test_every_metric_uses_the_metric_form(spark):
    p = preds(spark, COMPATIBLE)
    a, b = F.col("prediction_text"), F.col("reference_text")
    assert {tuple(r) for r in p.select(T.char_distance(a, b), T.word_distance(a, b), F.size(F.array_except(T.metric_words(a), T.metric_words(b)))).collect()} == {(0, 0, 0)}
    r = T.corpus_error_rate(p).first()
    assert (r["cer"], r["wer"], r["examples"]) == (0.0, 0.0, 4)
    assert {r["category"] for r in T.error_categories(p).collect()} == {"exact"}
    assert {r[0] for r in p.select(T.rouge_l_f1(T.metric_words(a), T.metric_words(b))).collect()} == {1.0}
    assert one(T.corpus_bleu(preds(spark, [("ﬁve Ｗords are in here", "five words are in here")])), "bleu") == pytest.approx(1.0)


def plain_table(h, r):
    rows = [list(range(len(h) + 1))]
    for i, x in enumerate(r, 1):
        row = [i]
        for j, y in enumerate(h, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows


def test_distances_and_paths_of_long_pairs(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(T, "KEPT_ROWS", 5)
    for _ in range(300):
        h, r = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        rows = plain_table(h, r)
        assert T.edit_distance(h, r) == rows[-1][-1] == T.edit_distance("".join(h), "".join(r)) == sum(T._path(h, r))
        d, i, s = T._path(h, r)
        assert len(h) - i == len(r) - d and s <= min(len(h), len(r))
    many = [f"w{i}" for i in range(60_000)]  # more words than a character set has letters
    assert T.edit_distance(many, many[1:] + ["x"]) == 2


def test_an_edit_distance_steps_over_the_shorter_side():
    class Counted(str):
        steps = 0

        def __iter__(self):
            for x in str.__iter__(self):
                Counted.steps += 1
                yield x

        def __getitem__(self, k):
            return Counted(str.__getitem__(self, k)) if isinstance(k, slice) else str.__getitem__(self, k)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[-1] + 1))
        return row[-1]

    for a, b in [("the", "quite another text, and a longer one " * 20), ("x " * 30, "abxba xx" * 17), ("", "abc"), ("kitten", "sitting")]:
        Counted.steps = 0
        assert T.edit_distance(Counted(a), Counted(b)) == T.edit_distance(b, a) == plain(a, b)
        assert Counted.steps <= len(a) + len(b)


def test_predictions_are_not_ordered_by_run_in_one_task(spark):
    from evidara.plans import views

    spread, template = (f(spark, "/root/testdata/sf0.001", "predictions") for f in (views.view, views.templated))
    assert spread.schema == template.schema
    assert spread.exceptAll(template).count() == template.exceptAll(spread).count() == 0
    plan = spread._jdf.queryExecution().executedPlan().toString()
    orders = [x for x in plan.splitlines() if "Sort [" in x and "hash_" in x]
    assert orders and all("bucket_" in x for x in orders)


def test_categories_of_missing_texts_and_of_long_ones(spark):
    long = " ".join(f"w{i}" for i in range(600))
    rows = [("a", None, "x y"), ("b", "x x", None), ("c", "", None), ("d", long + " z", long), ("e", long.replace("w300 ", ""), long), ("f", "b a", "a b"), ("g", "the the", "the cat")]
    p = spark.createDataFrame([("r", "full", i, h, r) for i, h, r in rows], "run_id string, control string, sample_id string, prediction_text string, reference_text string")
    got = {r["sample_id"]: r["category"] for r in T.error_categories(p).collect()}
    assert got == {"a": None, "b": "repetition", "c": "empty", "d": "hallucination", "e": "omission", "f": "substitution", "g": "repetition"}
    assert T._path(long.split(), long.split()[:-300]) == (0, 300, 0)


def rows_of_odd_samples():
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "b", "ç", "Fish", "fish,", "(x", "y)", ".", "rare%d" % rng.randint(0, 40)])
    rows = [(str(i), " ".join(word() for _ in range(rng.randint(0, 30))), "train" if i % 3 else "test") for i in range(40)]
    return rows + [("40", None, "train"), ("41", "", "test"), ("42", "unseen words", None), (None, "a b zzz", "test"), ("7", "a second row of it", "test"), ("7", "b", "train"), (None, "fish", "train")]


@pytest.mark.parametrize("hot", [0, 3, 1 << 17])
def test_packed_encoding_is_that_of_rows(spark, monkeypatch, hot):
    """Whatever share of the vocabulary is told to the tasks; samples without an id, and with several rows, too."""
    monkeypatch.setattr(T, "HOT", hot)
    s = spark.createDataFrame(rows_of_odd_samples(), "sample_id string, text string, split string")
    v = T.vocabulary(s)
    plain = T.encoded(s, v)
    packed = T.encoded_texts(s, v)
    got = packed.select("sample_id", F.posexplode("ids").alias("pos", "token_id"))
    key = lambda r: (r[0] or "", r[1], r[2])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in plain.collect()), key=key)
    assert sorted(T.decoded_texts(packed, v).collect(), key=str) == sorted(T.decoded(plain, v).collect(), key=str)


def test_packed_encoding_shuffles_no_row_for_a_token(spark):
    """Before, each token of a text was a row of two joins."""
    s = spark.createDataFrame([(str(i), "one two three " * 200, "train") for i in range(20)], "sample_id string, text string, split string")
    v = T.vocabulary(s)
    e = T.encoded_texts(s, v)
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and e.count() == 20 and T.decoded_texts(e, v).count() == 20
