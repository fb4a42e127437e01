"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import collections
import hashlib
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidara.llm import embedding_join, html_text, langid, license_scan, mixing, ngram_join, packing, quality, sharding, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def corpus(seed=0, n=60):
    """Random texts with near copies, exact copies, shared passages, and odd rows."""
    rng = random.Random(seed)
    passage = rng.choices(WORDS, k=70)
    texts = []
    for i in range(n):
        kind = i % 5
        if kind == 1 and texts:
            words = split(rng.choice(texts))
            for _ in range(len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        elif kind == 2 and texts:
            texts.append(rng.choice(texts))
        elif kind == 3:
            texts.append(" ".join(rng.choices(WORDS, k=rng.randint(5, 60)) + passage) + "\n" + " ".join(rng.choices(WORDS, k=20)))
        else:
            texts.append(" ".join(rng.choices(WORDS, k=rng.randint(1, 300))))
    rows = [(i + 1, t, "en" if i % 3 else "fr", None if i % 7 == 0 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    return rows + [(901, None, None, None, None), (902, "", "en", "s1", 0), (903, " \n\t ", "en", "s1", 4), (904, "one", "en", "s2", 3), (905, "one", "en", "s2", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns with names that operators use themselves
    return spark.createDataFrame(corpus(), DOCS).withColumn("size", F.lit("x")).withColumn("key", F.lit(1)).withColumn("shard", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_against_plain(spark, docs, none):
    rows = [*corpus(), (906, "a b c d e f g h " * 6, "en", "s", 1), (907, "home | about | news | help\nall rights reserved.\nThis line stays, as it should, with enough words to count as text for us.\n" * 2, "en", "s", 1)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        w = split(text)
        seen = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {p for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
    assert got[907]["navigation_words"] == 14 and "about" not in got[907]["clean_text"]
    assert quality.judged(none).count() == 0
    assert quality.keep_good_documents(docs).columns == docs.columns


def test_ngram_join_against_all_pairs(spark, docs, none):
    rows = corpus()
    sets = {}
    for i, text, *_ in rows:
        w = split((text or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs).collect()}
    assert got == want
    assert ngram_join.similar_documents(none).count() == 0
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, c in want.values()})


def test_trie_links_keep_all_components():
    rng = np.random.default_rng(5)
    for _ in range(15):
        base = [rng.choice(300, rng.integers(5, 60), replace=False) for _ in range(4)]
        sets = {}
        for _ in range(250):
            b = base[rng.integers(4)]
            s = np.unique(np.concatenate([rng.permutation(b)[rng.integers(0, max(1, len(b) // 3)) :], rng.choice(4000, rng.integers(0, 8)) + 1000])).astype(np.uint64)
            sets[s.tobytes()] = s
        sets = list(sets.values())

        def components(links):
            label = list(range(len(sets)))
            for i, j in links:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
            return sorted(sorted(i for i in range(len(sets)) if label[i] == x) for x in set(label))

        near = lambda a, b: 175 * len(np.intersect1d(a, b, assume_unique=True)) >= 75 * (len(a) + len(b))
        brute = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
        assert components(ngram_join.trie_links(sets)) == components(brute)


def test_substring_dedup_against_plain(docs, none):
    rows = [(i, split(t)) for i, t, *_ in corpus()]
    first = {}
    for i, w in rows:
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    got = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs, keep_text=True).collect()}
    removed = 0
    for i, w in rows:
        gone = {p for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for p in range(j, j + 50)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        r = got[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert split(r["kept_text"]) == kept
        removed += len(gone)
    assert removed and got[901]["kept_text"] is None
    assert substring_dedup.without_repeats(none).count() == 0
    out = substring_dedup.drop_repeated_passages(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_html_blocks():
    tree = html_text.fitted_tree()
    page = """<html><head><title>No</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body><header><a href=/>Home</a></header>
    <nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="ad">Buy now!</div><!-- <p>no</p> --><article><h1>A &amp; B</h1><p>First   <b>bold</b>
    text &#233;&copy</p><p>Second<br>line &lt;ok&gt;<div class="comments"><p>I agree, nice words here.</p></div></article>
    <aside><p>Related things to read next week.</p></aside><form><p>Your mail</p><input></form><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page, tree) == "A & B\nFirst bold text é©\nSecond\nline <ok>"
    assert html_text.main_text("", tree) == ""
    assert html_text.main_text("<p", tree) == ""


def test_html_rows(spark):
    p = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>x y"), (3, "u", "<article><p>x y")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extracted(p).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "x y", 3), (3, "x y", 3)]
    assert html_text.extracted(p.where("page_id > 9")).count() == 0


def test_packing_round_trip(docs, none):
    path = packing.tokenizer_path()
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in corpus()}
    rows = packing.packed(docs, window=256, shard_tokens=3000).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert sum(n for _, n in pieces[i]) == len(x) and len({s for s, _ in pieces[i]}) == len(pieces[i])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at < 256 and at & (at - 1) == 0
    assert packing.packed(none).count() == 0


def test_tokens_of_odd_texts():
    path = packing.tokenizer_path()
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    import pyarrow as pa

    t = packing.WordTokenizer(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZéßñ'’…,.;:!?#*$%&()-<|>0123 \t\n ́日") for _ in range(rng.randint(0, 60))) for _ in range(800)] + ["a<|endoftext|>b.", "don't. we're, 's", None, ""]
    texts += ["A<|ENDOFTEXT|>b", "<|EndOfText|>", "X <|endoftext|> Y<|STARTOFTEXT|>Z <| AB |>", "É<|endoftext|>É"]
    w = packing.apart(packing.lowered(pa.array(texts)))
    flat, n = t.encode(w)
    ends = np.concatenate([[0], np.cumsum(n)])[w.first]
    for i, x in enumerate(texts):
        assert flat[ends[i] : ends[i + 1]].tolist() == t.tokenizer.encode(x or "", add_special_tokens=False).ids


def test_every_term_of_a_seed_counts():
    units = [np.arange(100), np.arange(90, 100), np.arange(100, 110)]
    idf = np.linspace(3.0, 1.0, 110)  # what the first two share has the least weight
    assert packing.Index(units, idf, 40.0).of(0)[1] > 0


def test_alike_documents_meet_in_a_shard(spark):
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 * t, 100 * t + 100, size=(40, 60)) for t in range(8)]
    ids = [u.astype("<u4").tobytes() for t in topics for u in t]
    place = rng.permutation(len(ids))
    rows = [(int(place[i]), ids[i], 0, 60) for i in range(len(ids))]
    copies = [(1000 + i, ids[0], 0, 60) for i in range(400)]
    idf = spark.sparkContext.broadcast(np.full(800, 3.0))
    units = spark.createDataFrame(rows, "doc_id long, ids binary, base long, n_tokens long")
    shard = {r["doc_id"]: r["shard"] for r in packing.dealt(units, idf, 60 * len(rows), 2400).collect()}
    index = packing.Index([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in ids], idf.value, 60.0)
    met = []
    for q in range(len(ids)):
        best = [u for u in np.argsort(-index.of(q), kind="stable") if u != q][:10]
        met += [shard[int(place[u])] == shard[int(place[q])] for u in best]
    assert np.mean(met) > 0.6  # one in eight by a hash
    units = spark.createDataFrame(rows + copies, "doc_id long, ids binary, base long, n_tokens long")
    sizes = collections.Counter(r["shard"] for r in packing.dealt(units, idf, 60 * 720, 2400).collect())
    assert sum(sizes.values()) == 720 and max(sizes.values()) * 60 < 2 * 2400  # many copies are parted


def test_neighbours_share_a_sequence():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * t, 100 * t + 100, size=(8, 30)) for t in range(1, 5)]
    units = [u for t in topics for u in t]
    order = rng.permutation(len(units))
    idf = np.full(600, 3.0)
    sequences = packing.fill([units[i].astype(np.int64) for i in order], idf, 30.0, window=240)
    full = [s for s in sequences if sum(p[2] for p in s) == 240]
    same = [len({order[u] // 8 for u, _, _ in s}) for s in full]
    assert np.mean(same) < 2.0


def test_mixture(spark, docs, none):
    m = mixing.mixed(docs).collect()
    sizes = {r["doc_id"]: len(split(t)) for r, t in zip(m, [None] * len(m), strict=True) if t} or {i: len(split(t)) for i, t, *_ in corpus()}
    taken, source = collections.Counter(), {}
    for r in m:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        source[r["source"]] = (r["source_size"], r["target"])
    for s, (n, target) in source.items():
        assert target <= 2 * n + 1e-6 and abs(taken[s] - target) <= 1
    assert sum(t for _, t in source.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(m) == sorted(mixing.mixed(docs.repartition(5)).collect())
    assert mixing.mixed(none).count() == 0
    out = mixing.sample_mixture(docs)
    assert out.columns == docs.columns
    got = collections.Counter()
    for r in out.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(split(r["text"]))
    assert {k: v for k, v in got.items() if v} == {r["doc_id"]: r["taken"] for r in m if r["taken"]}


def test_sharding(docs, none):
    rows = sharding.sharded(docs).collect()

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    texts = {i: t for i, t, *_ in corpus()}
    for r in rows:
        key = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 16), jump(key, 17))
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 16)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.sharded(none).count() == 0


def test_licences(spark, none):
    texts = ["Text first.\nReleased under the MIT License.", "MIT License\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Licensed under CC BY-NC 4.0. All rights reserved.", "nothing here", None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("rule", F.lit(1))
    got = {r["doc_id"]: (r["n_license_sentences"], r["rule"], r["license"]) for r in license_scan.scanned(d).collect()}
    assert got == {0: (1, "mit-ref", "MIT"), 1: (2, "mit-text", "MIT"), 2: (2, "ccbync4-ref", "CC-BY-NC-4.0"), 3: (0, None, None), 4: (0, None, None), 5: (0, None, None)}
    assert all(any(t in re.sub("[^a-z0-9]+", " ", s.lower()) for t in license_scan.TRIGGERS) for s in license_scan.SENTENCES.values())
    assert license_scan.scanned(none).count() == 0


@pytest.mark.parametrize("width", [None, 72, 40])
def test_licences_every_sentence_and_rule(spark, width):
    def lines(sid, prefix=""):
        s = license_scan.SENTENCES[sid]
        return "\n".join(textwrap.wrap(s, width, initial_indent=prefix, subsequent_indent=prefix, break_long_words=False)) if width else prefix + s

    names = list(license_scan.SENTENCES)
    texts = [lines(sid) for sid in names] + ["Some text without an end\n\n" + lines(sid, " * ") + "\n\nMore text." for sid in names]
    texts += ["\n\n".join(lines(sid, "# ") for sid in ids) for _, _, ids in license_scan.RULES]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scanned(d).collect()}
    assert [got[i]["sentence_ids"] for i in range(2 * len(names))] == names * 2
    assert [(got[2 * len(names) + i]["rule"], got[2 * len(names) + i]["license"]) for i in range(len(license_scan.RULES))] == [r[:2] for r in license_scan.RULES]


def test_language_held_out(spark, none):
    rng = random.Random(2)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "xyzab "}
    rows = []
    for i in range(240):
        lang = list(alphabets)[i % 3]
        rows.append((i, "".join(rng.choice(alphabets[lang]) for _ in range(120)), lang if i % 10 else None))
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    got = {r["doc_id"]: r for r in langid.identified(d).collect()}
    for i, _, _ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
    right = [got[i]["lang_pred"] == list(alphabets)[i % 3] for i in range(240) if got[i]["held_out"]]
    assert sum(right) >= 0.95 * len(right)
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert langid.identified(none).count() == 0


def test_model_sums_to_one(spark):
    import pandas as pd

    texts = ["abba abab", "babb aab"]
    c, marks = langid.codes(texts)
    rows = [("x", n, int(g), 1) for n in range(1, langid.ORDER + 1) for g in langid.grams(c, n)]
    counts = pd.DataFrame(rows, columns=["lang", "n", "gram", "k"]).groupby(["lang", "n", "gram"], as_index=False).sum()
    m = langid.Model(counts)
    context = int(langid.grams(c, 3)[2])
    seen = m.grams[1]
    p = m._at(4, (np.uint64(context) << np.uint64(langid.BITS)) | seen)[:, 0]
    assert p.sum() == pytest.approx(1.0, abs=m.floor + 1e-6)


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 12))
    v = [centre[i % 6] + rng.normal(scale=0.25, size=12) for i in range(300)]
    v += [v[0], v[0], v[5] * 3, np.zeros(12)]
    rows = [(i, [float(np.float32(x)) for x in a]) for i, a in enumerate(v)] + [(900, None), (901, [float("nan")] * 12), (902, [1.0, None]), (903, []), (904, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).withColumn("n", F.lit("x"))
    got = {r["vec_id"]: r for r in embedding_join.near_vectors(d, block=16).collect()}
    x = np.array([np.array(r[1], dtype=np.float32).astype(float) for r in rows[:304]])
    norms = np.linalg.norm(x, axis=1)
    x = x / np.where(norms > 0, norms, 1)[:, None]
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    for i in range(304):
        assert got[i]["n_links"] == near[i].sum()
    label = np.arange(304)
    for _ in range(304):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(304)])
        if (new == label).all():
            break
        label = new
    assert [got[i]["component_id"] for i in range(304)] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (303, 900, 901, 902, 903, 904))
    assert embedding_join.near_vectors(d.where("vec_id > 9999")).count() == 0


def test_pipeline(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() > 0


def test_word_figures_of_a_batch_against_plain():
    import pyarrow as pa

    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "é", "日本", " x", "b\tc"]) for _ in range(n)) for n in (0, 1, 7, 8, 9, 40, 40, 400)] + [None, "", " \n ", "one two three four five six seven eight nine " * 3]
    for t, (n, chars, repeated) in zip(texts, quality._counted(pa.array(texts)).tolist(), strict=True):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
        assert (n, chars, repeated) == (len(ws), sum(map(len, ws)), len(hit))


def test_line_quality_runs_no_python_and_counts_as_plain(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "é", "日本", " x", "b\tc", "d\n", "e\r\n", "f\x0b"]) for _ in range(n)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 40, 400)] + [None, "", " \n ", "one two three four five six seven eight nine " * 3, "w " * 30]
    j = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {x["doc_id"]: (x["n_words"], x["word_chars"], x["n_repeat_words"]) for x in j.collect()}
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        hit = {k + m for k, g in enumerate(grams) if grams.count(g) > 1 for m in range(8)}
        assert got[i] == (len(ws), sum(map(len, ws)), len(hit)), i


def test_every_phrase_is_found_in_its_line(spark):
    """Also where its words lie further apart, in capitals, inside other words, and in a text whose other lines have none."""
    forms = [lambda p: p, lambda p: p.upper(), lambda p: p.replace(" ", " \t "), lambda p: f"x{p}x", lambda p: p.replace("k", "K")]
    good = "This line stays, as it should, with enough words to count as text for us."
    rows = [(i, f"{good}\n{f(p)}\n{good}", p) for i, (p, f) in enumerate((p, f) for p in quality.BOILERPLATE for f in forms)]
    d = spark.createDataFrame(rows, "doc_id long, text string, phrase string")
    assert [r["phrase"] for r in d.select("phrase", quality.line_verdicts(F.col("text")).alias("v")).where("v[1].rule is null or v[1].rule <> 'boilerplate' or v[0].rule is not null").collect()] == []


def test_mixture_reads_texts_once_for_sizes(spark, docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "md5(" not in plan
