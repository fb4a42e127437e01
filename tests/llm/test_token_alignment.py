"""Token alignment against a plain alignment of whole texts, fragments that compose, and long texts in stretches."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest

from evidara.llm import token_alignment as T
from tests.llm.test_operators import corpus

ODD = ["", " ", "  a  b ", "x\ny z\t w", "naïve é ü  ß", "日本語 テスト 　 x", "<|endoftext|> <s> </s> <unk>", "▁x a▁ b", "é x", "emoji 🎉🎉 z", "a\x00b c\x1f d", "ends ", "don't we'll 'tis", "x" * 300, "     x", "　 　  x y", "Привет  мир да", "\n\n a"]


@pytest.fixture(scope="module")
def t():
    return T.load(*T.paths())


def alone(t, text):
    """(a ids, b ids, groups) of a text that is encoded whole; None without tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    size = lambda ids, of: [len(of[i].as_py()) for i in ids]
    if any(b"".join(of[i].as_py() for i in ids) != whole for ids, of in ((a, t.bytes_a), (b, t.bytes_b))):
        return None
    ends_a, ends_b = (dict(zip(itertools.accumulate(size(ids, of)), range(1, len(ids) + 1), strict=True)) for ids, of in ((a, t.bytes_a), (b, t.bytes_b)))
    groups, i, j = [], 0, 0
    for e in sorted(ends_a.keys() & ends_b.keys()):
        groups.append((a[i : ends_a[e]], b[j : ends_b[e]]))
        i, j = ends_a[e], ends_b[e]
    return a, b, groups


def expected(t, rows):
    done = [(i, alone(t, x)) for i, x in rows]
    count = collections.Counter((a[-1], b[-1]) for _, x in done if x for a, b in x[2])
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, x in done:
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in x[2]]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in x[2])
        out.append((i, len(x[0]), len(x[1]), len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


def results(df):
    return collections.Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


@pytest.mark.parametrize("most", [T.BROADCAST_PAIRS, 3])
def test_against_whole_texts(spark, t, monkeypatch, most):
    monkeypatch.setattr(T, "BROADCAST_PAIRS", most)
    rows = [(r[0], r[1]) for r in corpus()] + [(2000 + i, x) for i, x in enumerate(ODD)] + [(7, "the same id"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as part", "2 as pairs").repartition(3)
    assert results(T.aligned(docs)) == expected(t, rows)


def test_long_texts_in_stretches(spark, t, monkeypatch):
    rng = random.Random(5)
    words = ["the", "naïveté", "über", "tokenization", "don't", "ab\ncd", "日本語", "x  y", "'s", "1234567"]
    rows = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate((900, 40, 2500, 300))] + [(10, "日本" * 900), (11, "▁ " * 800), (12, " " * 3000), (13, "plain " * 500 + "\udc00".encode("utf-8", "replace").decode())]
    monkeypatch.setattr(T, "STRETCH_BYTES", 500)
    monkeypatch.setattr(T, "RANGE_BYTES", 64)
    monkeypatch.setattr(T.cut, "__defaults__", (500,))
    monkeypatch.setattr(T, "FAN", 3)
    assert max(len(T.cut(x)) for _, x in rows) > 9
    assert results(T.aligned(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(t, rows)


def test_fragments_compose_in_any_order(t):
    rng = random.Random(2)
    for text in ["a naïve tokenization don't 日本語 🎉 " * 6, "x" * 200, "é", "Überraschung 12345 again"]:
        a, b, groups = alone(t, text)
        a, b = np.array(a), np.array(b)
        want = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups) + ";"
        for size in (1, 2, 3, 5, 17, 1000):
            parts = T.fragments(t, a, b, size)
            while len(parts) > 1:  # neighbours meet in random order
                k = rng.randrange(len(parts) - 1)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            got, pairs = parts[0].closed()
            assert got.decode() == want
            assert pairs.tolist() == [x[-1] * T.PAIR + y[-1] for x, y in groups]


def test_no_rows(spark):
    assert T.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = T.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert results(out) == collections.Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])
