"""Repeated rows, groups that do not fit a task, held-out pages, plain BM25, and the pipeline stage by stage."""

import collections
import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidara.llm import embedding_join, html_text, langid, license_scan, mixing, ngram_join, packing, quality, substring_dedup
from evidara.llm import words as W
from tests.llm.test_operators import DOCS, WORDS, corpus, split

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = split((text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets):
    """{id: smallest reachable id} by comparing all pairs; sets of one id are joined."""
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            n = len(s & t)
            if a < b and n and 100 * n >= 75 * (len(s) + len(t) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def near_copies(seed, n, edits):
    """Variants of two texts, and texts that share a passage with one of them."""
    rng = random.Random(seed)
    base = [rng.choices(WORDS, k=90) for _ in range(2)]
    out = []
    for i in range(n):
        w = list(base[i % 2])
        if i % 7 == 6:
            w = rng.choices(WORDS, k=60) + w[:40]
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append((i + 1, " ".join(w)))
    return out


@pytest.mark.parametrize("limit", [400, 3000, ngram_join.LIMIT])
def test_near_copies_in_parts(spark, limit):
    rows = near_copies(3, 80, 9)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA), limit=limit).collect()}
    assert got == components([(i, shingles(t)) for i, t in rows])


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choices(WORDS, k=120)) for _ in range(3))
    rows = [(1, a, "x"), (2, a + " " + b, "y"), (2, c, "y"), (2, c, "y"), (3, c, "z"), (4, "short text", "z"), (4, None, "z"), (None, a, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, version string")
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.without_repeats(d).collect())
    assert got == collections.Counter([(1, 120, 0), (2, 240, 120), (2, 120, 0), (2, 120, 0), (3, 120, 120), (4, 2, 0), (4, 0, 0), (None, 120, 0)])
    out = substring_dedup.drop_repeated_passages(d)
    assert out.columns == d.columns
    left = collections.Counter((r["doc_id"], " ".join(split(r["text"])), r["version"]) for r in out.collect())
    assert left == collections.Counter([(1, a, "x"), (2, b, "y"), (2, c, "y"), (2, c, "y"), (3, "", "z"), (4, "short text", "z"), (4, "", "z"), (None, a, "z")])
    near = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_documents(d).collect()}
    assert near == {1: 1, 2: 2, 3: 2, 4: 4}
    kept = [sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.drop_near_duplicates(d.repartition(n)).collect()) for n in (1, 3)]
    assert kept[0] == kept[1] == [(0, a), (1, a), (2, min(c, a + " " + b)), (4, "")]


def test_repeats_within_and_between_lots():
    def batch(rows):
        z = [(i, 0, t, [0]) for i, t in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in z]), pa.array([0] * len(z), pa.int64()), pa.array([r[2] for r in z])], names=["doc_id", "version", "text"])

    line = " ".join(WORDS[:60])
    b = batch([(5, line + "\n" + line + "\n" + line), (7, line)])
    anchors = pa.Table.from_batches(list(substring_dedup._anchors(50, 8)([b])))
    by = collections.defaultdict(list)
    for a, i in zip(anchors["anchor"].to_pylist(), anchors["doc_id"].to_pylist(), strict=True):
        by[i].append(a)
    import zstandard

    squeezed = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), pa.array([zstandard.compress(t.encode()) for t in b.column("text").to_pylist()]), pa.array([by[5], by[7]], pa.list_(pa.int64()))], names=["doc_id", "version", "z", "anchors"])
    dealt = pa.Table.from_batches(list(substring_dedup._candidates(50, 8, 8)([squeezed])))
    assert [r["places"] for r in dealt.to_pylist() if r["codes"] is None] == [list(range(11))]  # the second document's windows are found at once
    other = pa.Table.from_batches(list(substring_dedup._candidates(50, 8, 8)([squeezed.slice(0, 1).set_column(0, "doc_id", pa.array([3]))])))
    places = collections.defaultdict(list)
    both = pa.concat_tables([dealt, other])
    for bucket in set(both["bucket"].to_pylist()):
        for r in substring_dedup._repeated(both.filter(pa.compute.equal(both["bucket"], bucket))).to_pylist():
            places[r["doc_id"]] += r["places"]
    assert {k: sorted(v) for k, v in places.items()} == {5: list(range(131)), 7: list(range(11))}


def test_a_text_longer_than_a_chunk():
    rng = random.Random(6)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(400_000))
    assert len(long) > W.CHUNK_BYTES
    t = pa.array(["one two", long, None])
    w = W.layout(t)
    assert (w.first[2] - w.first[1]) == 400_000
    h = w.hashes()
    assert h[2] == W.layout(pa.array([split(long)[0]])).hashes()[0] and h[-1] == W.layout(pa.array([split(long)[-1]])).hashes()[0]
    assert [c.num_rows for c in W.chunks([pa.RecordBatch.from_arrays([t], names=["text"])], "text")] == [1, 2]
    sets = list(ngram_join.shingle_sets(t, 5))
    assert [n for n, _ in sets] == [2, 400_000, 0] and len(sets[1][1]) == len(shingles(long))


def test_counts_of_frequent_shingles():
    rng = np.random.default_rng(0)
    f = ngram_join.Frequent()
    for _ in range(30):
        f.add([np.unique(np.concatenate([rng.integers(1000, 1 << 60, 50_000).astype(np.uint64), np.arange(20, dtype=np.uint64)])) for _ in range(3)])
    f.fold()
    found = dict(zip(f.keys.tolist(), f.counts.tolist(), strict=True))
    assert all(found.get(i, 0) > 60 for i in range(20)) and all(found[i] <= 90 for i in range(20)) and len(found) <= ngram_join.COUNTERS


def test_equal_rows_are_mixed_as_often_as_taken(spark):
    text = " ".join(WORDS[:7])
    rows = [(1, text, "a")] * 6 + [(2, " ".join(WORDS[:20]), "b"), (2, " ".join(WORDS[:20]), "a"), (3, None, "a"), (None, "x y z", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_key", F.lit("mine"))
    taken = sum(r["taken"] for r in mixing.mixed(d).collect())
    out = mixing.sample_mixture(d)
    assert out.columns == d.columns
    assert sum(len(split(r["text"])) for r in out.collect()) == taken


def test_sources_at_the_cap(spark):
    rows = [(i, " ".join(WORDS[: 1 + i % 5]), f"s{i % 6}") for i in range(60)] + [(100, " ".join(WORDS), "z")]
    m = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    targets = {r["source"]: (r["source_size"], r["target"]) for r in m}
    assert sum(t == 2 * n for n, t in targets.values()) >= 2
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * sum(n for n, _ in targets.values()))


#: Pages that the labelled table was not made from, and their text.
P = "This paragraph has some twenty words or more, so that it reads like the running text of an article on the web."
PAGES = (
    (f"<body><div><p>{P}</p></div></body>", [P]),
    (f"<script>for(i=0;i<n;i++){{ if (a<b) x='</p>'; }}</script><p>{P}</p><p>{P}</p>", [P, P]),
    (f"<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a></ul><h1>A long enough heading of the page</h1><p>{P}<p>{P}<ul><li><a>Read the other piece of last week</a><li><a>And the one from the week before</a></ul>", ["A long enough heading of the page", P, P]),
    (f"<div class='navBar'><a href=/>Home</a></div><div class='content no-sidebar'><h2>Prices</h2><p>{P}</p><p class=share-price>Shares rose by four percent on that day in trading.</p><p>{P}</p></div><div id=comments><p>{P}</p></div><div class=siteFooter>Made by us</div>", ["Prices", P, "Shares rose by four percent on that day in trading.", P]),
    (f"<form id=page><nav><a>One</a></nav><h1>The heading of this page here</h1><p>{P}</p><p>{P}</p></form><footer>&copy; us</footer>", ["The heading of this page here", P, P]),
    (f"<article><header><h1>Inside</h1></header><p>{P}<br>Last line.</p><aside>{P}</aside></article><div class='cookie-banner'>{P}</div>", ["Inside", P, "Last line."]),
    (f"<select><option>One<option>Two</select><button>Go</button><p>{P}</p><button><p>{P}</p>", [P, P]),
    (f"<main><p>Caf&eacute; &#x41; &lt;b&gt;</p><svg><text>no</text></svg><style>p{{}}</style><p>{P}</p></main>", ["Café A <b>", P]),
)

#: More such pages: quotes by the states of a tokenizer, names that mislead, short lines, links inside articles, blocks inside links.
PAGES += (
    (f"<div data-x=it's><p>{P}</p></div><p>It's {P}</p>", [P, f"It's {P}"]),
    (f'<p class="x>{P}</p><p>{P}</p>', [P, P]),
    (f"<p title='a > b' data-y=\"</p>\">{P}</p><!--><p>{P}</p><!-- <p>no --!><p>{P}</p></ p>", [P, P, P]),
    (f'<article><div class="reply"><p>{P}</p></div><p class="login-history">{P}</p><div class="menu-of-the-day"><p>{P}</p></div></article>', [P, P, P]),
    (f"<article><h1>A heading</h1><p>{P}</p><ul><li><a href=/1>One more piece</a><li><a href=/2>And another one</a><li><a href=/3>Third piece here</a></ul><p>{P}</p></article>", ["A heading", P, P]),
    (f"<nav><a href=/>Home</a></nav><main><h2><a href=/p>A title that links to itself</a></h2><p>{P}</p><p>Why?</p><p>{P}</p><p>No.</p></main><footer>Us</footer>", ["A title that links to itself", P, "Why?", P, "No."]),
    (f"<main><p>{P}</p></main><div><a href=/1><div>A teaser of the other text</div></a><a href=/2><div>And one of the next</div></a><a href=/3><div>More to read in here</div></a></div>", [P]),
    (f"<main><table><tr><td class=sidebar>Left<td><p>{P}</p><tr><td>{P}</table></main>", [P, P]),
    (f"<a name=top><p>{P}</p><p>{P}</p>", [P, P]),
    (f"<div class='post'><p>{P}</p><div class='comment-list'><p>{P}</p><p>{P}</p></div></div><div class='c-ad__box'><p>{P}</p></div>", [P]),
)


def test_long_pages_take_time_by_their_length():
    tree = html_text.fitted_tree()
    n = 60_000
    for page, want in (("<div>" * n + P, P), ("<a " * n + '"', ""), ("<b y='>" * n + "x", "x"), ('<a x="' * n + "x", ""), ("<button>" * n + P, P), (f"<div class=ad>{'<span class=ad>' * n}x", "")):
        began = time.monotonic()
        assert html_text.main_text(page, tree) == want, page[:20]
        assert time.monotonic() - began < 10  # half a second; hours if it grew with the square
    long = "".join(f"<p>{P}</p>" for _ in range(20_000))
    assert html_text.main_text(long, tree) == "\n".join([P] * 20_000)


def test_pages_not_learned_from():
    tree = html_text.fitted_tree()
    for page, want in PAGES:
        assert html_text.main_text(page, tree).split("\n")[: len(want)] == want, page[:60]
        assert len(html_text.main_text(page, tree)) <= len("\n".join(want)) + 40
    rows = html_text.labelled()
    assert len(rows) > 200
    own = [r for r in rows if r[7] == 0 and r[8] == 0]  # nothing is named: words and links decide
    tree_own = html_text.grow(np.array(own, dtype=float)[:, :-1], np.array(own, dtype=float)[:, -1])
    x = np.array([(2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0), (80, 0.02, 12, 0.0, 60, 0.0, 0, 0, 0)])
    assert html_text.predict(tree_own, x).tolist() == [False, True]


def _plain_kneser_ney(texts: dict[str, list[str]], asked: list[str]) -> list[list[float]]:
    """Bits per character of each text asked by each language's interpolated Kneser-Ney model, by dictionaries of strings."""

    def line(x: str) -> str:
        out = ""
        for ch in x:
            ch = ch.lower()[0] if ch.isalpha() else " "
            if ch != " " or out and out[-1] != " ":
                out += ch
        return f" {out} "

    alphabet = {ch for ts in texts.values() for t in ts for ch in line(t)}
    floor = 1 / max(2, len(alphabet) + 1)
    result = []
    for lang in sorted(texts):
        count = {n: collections.Counter(x[i : i + n] for x in map(line, texts[lang]) for i in range(len(x) - n + 1)) for n in range(1, langid.ORDER + 1)}
        for n in range(1, langid.ORDER):
            count[n] = collections.Counter(g[1:] for g in count[n + 1])

        def p(g: str, count=count) -> float:
            if not g:
                return floor
            same = {x: k for x, k in count[len(g)].items() if x[:-1] == g[:-1]}
            if not same:
                return p(g[1:])
            total = sum(same.values())
            return max(same.get(g, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(same) / total * p(g[1:])

        bits = []
        for x in map(line, asked):
            padded = " " * (langid.ORDER - 2) + x
            bits.append(sum(-math.log2(p(padded[i - langid.ORDER : i])) for i in range(langid.ORDER, len(padded) + 1)) / (len(x) - 1))
        result.append(bits)
    return [list(b) for b in zip(*result, strict=True)]


def test_entropies_against_plain_kneser_ney():
    texts = {"aa": ["The cat sat, on the mat.", "A dog! and 2 cats", "  so it goes "], "bb": ["Der Hund saß auf der Matte", "und die Katze schlief"], "cc": ["一丁七万丈三上下", "丁一 万七", "Ꙁ 𝒳𝒴 𝒳"]}
    asked = ["the dog", "Die Matte ", "丁七万", "zzz", "x" * 300, "ascii 一 ß", "𝒳"]
    batch = pa.RecordBatch.from_pydict({"lang": [x for x, ts in texts.items() for _ in ts], "text": [t for ts in texts.values() for t in ts]})
    counts = pa.Table.from_batches(langid._count([batch])).to_pandas()
    model = langid.Model(counts)
    within = [t for t in asked if all(ord(ch) < 0x10000 for ch in t)]
    plain = {k: [t for t in ts if all(ord(ch) < 0x10000 for ch in t)] for k, ts in texts.items()}
    small = langid.Model(pa.Table.from_batches(langid._count([pa.RecordBatch.from_pydict({"lang": [x for x, ts in plain.items() for _ in ts], "text": [t for ts in plain.values() for t in ts]})])).to_pandas())
    assert np.allclose(small.entropies(within), _plain_kneser_ney(plain, within), atol=1e-9)
    together = model.entropies(asked)
    assert np.allclose(together, np.concatenate([model.entropies([t]) for t in asked]), atol=1e-12)
    assert together.argmin(axis=1).tolist()[:3] == [0, 1, 2]


def test_scores_and_choice_against_plain_bm25():
    rng = np.random.default_rng(3)
    units = [rng.integers(0, 60, rng.integers(5, 40)) for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(u) for u in units]), minlength=60)
    idf = np.log1p((40 - df + 0.5) / (df + 0.5))
    mean = float(np.mean([len(u) for u in units]))
    index = packing.Index(units, idf, mean)

    def plain(q, d):
        tf = collections.Counter(units[d].tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * len(units[d]) / mean)
        return math.fsum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in set(units[q].tolist()) if t in tf)

    for q in range(40):
        assert np.allclose(index.of(q), [plain(q, d) for d in range(40)])
    # the first sequence: the first seed, then its best unused neighbours, ties to the earlier, until the window is full
    sequences = packing.fill(units, idf, mean, window=100)
    order = [0, *sorted((d for d in range(1, 40) if plain(0, d) > 0), key=lambda d: (-plain(0, d), d))]
    want, room = [], 100
    for d in order:
        want.append((d, 0, min(room, len(units[d]))))
        room -= want[-1][2]
        if not room:
            break
    assert sequences[0] == want
    assert sorted(collections.Counter(u for s in sequences for u, _, _ in s)) == list(range(40))
    assert sum(n for s in sequences for _, _, n in s) == sum(map(len, units))


def test_vectors_in_several_blocks(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(5, 20))
    v = [centre[i % 5] + rng.normal(scale=0.2, size=20) for i in range(400)] + [rng.normal(size=20) for _ in range(300)]
    rows = [(i, [float(np.float32(x)) for x in a]) for i, a in enumerate(v)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    for block in (50, 200):
        got = {r["vec_id"]: r["n_links"] for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block, dims=6).collect()}
        assert [got[i] for i in range(700)] == near.sum(axis=1).tolist()


def test_distant_intervals_are_left_out():
    rng = np.random.default_rng(2)
    centre = np.eye(8)[:4] * 3
    x = np.concatenate([c + rng.normal(scale=0.02, size=(640, 8)) for c in centre])
    x /= np.linalg.norm(x, axis=1)[:, None]
    axes = embedding_join._axes([r.tobytes() for r in x], 4)
    eps = math.sqrt(0.1)
    p = embedding_join.Sequence(np.arange(len(x)), np.ones(len(x), dtype=np.int64), x, axes, eps)
    a, _ = embedding_join.near_leaves(p, p, True, eps)
    assert len(a) <= 260  # of 820 pairs of leaves those within a cluster, and a few at cell edges


def test_rejection_is_calibrated_on_other_texts(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(100)), "aa") for i in range(200)] + [(900, "zqxjk" * 30, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit = {r["doc_id"]: r["fitting"] for r in langid.training_rows(d).select("doc_id", "fitting").collect()}
    assert set(fit.values()) == {True, False}
    got = {r["doc_id"]: r for r in langid.identified(d).collect()}
    assert got[900]["rejected"] and sum(got[i]["rejected"] for i in range(200)) <= 10


def test_licence_texts(spark):
    s = license_scan.SENTENCES
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + s["mit-grant"] + "\n\n" + s["mit-notice"]
    bsd = "/*\n * " + s["bsd-redist"] + "\n *  1. " + s["bsd-source"] + "\n *  2. " + s["bsd-binary"] + "\n */"
    lgpl = s["lgpl21-free"] + "\n\n" + s["lgpl-warranty"]
    got = [r["license"] for r in license_scan.scanned(spark.createDataFrame([(1, mit), (2, bsd), (3, lgpl)], SCHEMA)).orderBy("doc_id").collect()]
    assert got == ["MIT", "BSD-2-Clause", "LGPL-2.1-or-later"]


def test_lines_by_shape_and_language(spark):
    text = "Home › News › Sport › Wetter\n" + "\n".join(["Start", "Über uns", "Kontakt", "Impressum hier", "Presse"]) + "\n\nAlle Rechte vorbehalten\n" + "Ein Satz mit vielen Wörtern steht hier, damit der Text lang genug ist und bleibt. Danach kommt noch einer, der andere Dinge sagt als der erste, und zwar recht ausführlich."
    r = quality.judged(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert r["navigation_words"] == 7 + 7 and r["boilerplate_words"] == 3 and r["kept"]
    assert split(r["clean_text"])[:2] == ["Ein", "Satz"]
    list_ = "\n".join(["milk", "bread", "eggs", "salt"]) + "\n" + "These four things are on the list, and more words follow so that it is long enough to be kept."
    assert quality.judged(spark.createDataFrame([(1, list_)], SCHEMA)).first()["n_failed_lines"] == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows = corpus(11, 50)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    def run(name, df):
        stages[name](spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = run("quality_rules", d)
    judged = {r["doc_id"]: r for r in quality.judged(d).collect()}
    assert read(good) == sorted((i, judged[i]["clean_text"]) for i in judged if judged[i]["kept"])
    one = run("near_duplicates", good)
    of = components([(i, shingles(t)) for i, t in read(good)])
    assert read(one) == sorted((i, t) for i, t in read(good) if of[i] == i)
    cut = run("repeated_passages", one)
    first = {}
    for i, t in read(one):
        w = split(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for (i, t), (k, left) in zip(read(one), read(cut), strict=True):
        w = split(t)
        gone = {p for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for p in range(j, j + 50)}
        assert i == k and split(left) == [x for p, x in enumerate(w) if p not in gone]
    mix = run("mixture", cut)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(cut).collect()}
    got = collections.Counter()
    for i, t in read(mix):
        got[i] += len(split(t))
    assert got == {i: n for i, n in taken.items() if n}
    import os

    if os.path.exists(packing.tokenizer_path()):
        packed = run("sequences", mix).collect()
        digest = collections.Counter((r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0)
        assert sum(digest.values()) == mix.count()
        assert all(r["length"] <= 4096 for r in packed) and hashlib


def test_words_of_lines_with_odd_white_space(spark):
    """A line's words are counted without splitting it; runs of white space, at its ends too, count once."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice([" ", "  ", "\t", "\x0b", "\f", "\r", "\n", "é ", "a", "b. ", " ", "| "]) for _ in range(60))) for i in range(60)]
    for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string")).select("*", quality.line_verdicts(F.col("text")).alias("v")).collect():
        lines = [split(x) for x in r["text"].split("\n")]
        assert [x["n"] for x in r["v"]] == [len(x) for x in lines]
        assert r["word_chars"] == sum(len(w) for x in lines for w in x)
