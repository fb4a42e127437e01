"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased, runs of other characters than letters become one space, and grams of up to
ORDER characters are coded in ORDER * 16 bits, a UTF-16 unit each, so that no two letters share a code. The models lie in sorted arrays of gram hashes,
one array per order with a column per language. The language with the lowest cross-entropy per
character wins; a threshold per language, calibrated on labelled texts that the model did not learn from, marks rejections.

What goes through the driver is bounded: the distinct grams of the training sample by the number of languages (a few hundred at most is assumed), and one number per language.
All grams of the sample are kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.session import few, plain, prepare, table

ORDER, DISCOUNT = 4, 0.75
#: The training sample: at most this many documents of a language, the first in hash order, each read whole.
TRAIN_DOCS = 400
#: Up to so many ids of training documents (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The share of a language's calibration texts, which the model has not learned from, that its rejection threshold lets pass.
PASS_SHARE = 0.995
BITS = 16  # of a character's code
CHUNK_CHARS = 1 << 20


def _classes() -> np.ndarray:
    """A code for every UTF-16 unit: letters their lower-case form, surrogates themselves, anything else 0, a space."""
    out = np.zeros(1 << 16, dtype=np.uint16)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha() or 0xD800 <= c < 0xE000:
            low = x.lower() if x.isalpha() else x
            out[c] = ord(low[0])
    return out


_CODES: list[np.ndarray] = []


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts on end, a space before and after each, and where each begins."""
    if not _CODES:
        _CODES.append(_classes())
    joined = "\0".join(["", *texts, ""]).encode("utf-16-le", "surrogatepass")
    raw = np.frombuffer(joined, dtype="<u2")
    c = _CODES[0][raw]
    # One space for a run of spaces, but the marks between texts stay (a null character inside a text is a space too).
    lens = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts], dtype=np.int64)
    marks = np.concatenate([[0], np.cumsum(lens + 1)])
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[marks] = True
    place = np.cumsum(keep) - 1
    return c[keep].astype(np.uint64), place[marks]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Codes of the ``n`` characters that end at each place from n - 1 on."""
    out = c[: len(c) - n + 1].copy()
    for k in range(1, n):
        out = (out << BITS) | c[k : len(c) - n + 1 + k]
    return out


def has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text)


def _count(batches):
    """(lang, order, gram, count) of each batch; grams over the mark between two texts are left out."""
    for b in batches:
        langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            mine = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
            if not mine:
                continue
            c, marks = codes(mine)
            for n in range(1, ORDER + 1):
                g = grams(c, n)
                over = np.zeros(len(c) + 1, dtype=np.int64)
                over[marks[1:-1]] = 1
                total = np.cumsum(over)
                start = np.arange(len(g))
                inner = total[np.minimum(start + n - 2, len(c))] - total[start] if n > 2 else np.zeros(len(g), dtype=np.int64)
                u, k = np.unique(g[inner == 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), n, dtype=np.int8)), pa.array(u.view(np.int64)), pa.array(k.astype(np.int64))], names=["lang", "n", "gram", "k"])


class Model:
    """Sorted gram arrays by order; ``logp[n]`` and ``back[n]`` hold a row per gram and a column per language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique().tolist())
        col = {x: i for i, x in enumerate(self.langs)}
        raw: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, ORDER + 1):
            part = counts[counts["n"] == n]
            u, at = np.unique(part["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
            m = np.zeros((len(u), len(self.langs)))
            np.add.at(m, (at, part["lang"].map(col).to_numpy()), part["k"].to_numpy())
            raw[n] = u, m
        self.grams: dict[int, np.ndarray] = {}
        self.prob: dict[int, np.ndarray] = {}
        self.back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lower = None
        self.floor = 1.0 / max(2, len(raw[1][0]) + 1)
        for n in range(1, ORDER + 1):
            u, m = raw[n]
            if n < ORDER:  # continuation counts: in how many longer grams it is the end
                longer, lm = raw[n + 1]
                at = np.searchsorted(u, longer & ((1 << (BITS * n)) - 1))
                m = np.zeros_like(m)
                np.add.at(m, at, (lm > 0).astype(float))
            context = u >> BITS
            cu, ci = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(cu), m.shape[1])), np.zeros((len(cu), m.shape[1]))
            np.add.at(total, ci, m)
            np.add.at(kinds, ci, (m > 0).astype(float))
            weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            below = np.full_like(m, self.floor) if n == 1 else lower(u & ((1 << (BITS * (n - 1))) - 1))
            p = np.maximum(m - DISCOUNT, 0) / np.maximum(total, 1)[ci] + weight[ci] * below
            self.grams[n], self.prob[n], self.back[n] = u, p, (cu, weight)
            lower = lambda g, n=n: self._at(n, g)

    def _at(self, n: int, g: np.ndarray) -> np.ndarray:
        """Probabilities of grams of order n in every language, by back-off where a gram is not stored."""
        if n == 0:
            return np.full((len(g), len(self.langs)), self.floor)
        u = self.grams[n]
        at = np.minimum(np.searchsorted(u, g), len(u) - 1)
        out = self.prob[n][at]
        if (miss := np.flatnonzero(u[at] != g)).size:
            cu, weight = self.back[n]
            c = g[miss] >> BITS
            ca = np.minimum(np.searchsorted(cu, c), len(cu) - 1)
            w = np.where((cu[ca] == c)[:, None], weight[ca], 1.0)
            out[miss] = w * self._at(n - 1, g[miss] & ((1 << (BITS * (n - 1))) - 1))
        return out

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Bits per character of every text in every language, each text by itself; no text may be without a letter."""
        c, marks = codes(texts)
        pad = ORDER - 2  # spaces more between texts, so that no gram reaches from one into the next
        c = np.insert(c, np.repeat(marks, pad), 0)
        code, u = pd.factorize(grams(c, ORDER))
        bits = -np.log2(self._at(ORDER, u))
        n = np.maximum(np.diff(marks), 1)
        marks = marks + pad * np.arange(1, len(marks) + 1)
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            s = np.concatenate([[0.0], np.cumsum(bits[code, k])])
            total[:, k] = s[marks[1:] - 2 * pad] - s[marks[:-1] - pad]
        return total / n[:, None]


def confidence(bits: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Posterior of the best language under equal priors, tempered: neighbouring characters are not independent."""
    best = bits.min(axis=1, keepdims=True)
    n = np.minimum(chars, 200)[:, None]
    return 1.0 / np.exp2(-(bits - best) * n / 4).sum(axis=1)


def training_rows(docs: DataFrame) -> DataFrame:
    """The bounded sample of labelled rows, lang, text and ``fitting``: non-null lang and text, crc32(doc_id) mod 4 other than 2.

    Where that is 3 rows calibrate, else they fit; of each kind and language TRAIN_DOCS documents at most, in hash order.
    The window holds ids only, and WindowGroupLimit cuts each task's rows to TRAIN_DOCS before they are sent."""
    d = plain(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    rest = F.expr("crc32(cast(doc_id as string)) % 4")
    d = d.withColumn("fitting", rest < 2).where(rest != 2)
    w = Window.partitionBy("lang", "fitting").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = d.select("doc_id", "lang", "fitting").select("*", F.row_number().over(w).alias("r")).where(F.col("r") <= TRAIN_DOCS).select("doc_id").distinct()
    return d.join(few(chosen, BROADCAST_IDS), "doc_id", "left_semi")


def fitted(docs: DataFrame) -> tuple[Model, np.ndarray]:
    """The model and each language's rejection threshold in bits per character; a language without calibration texts rejects nothing."""
    rows = training_rows(docs).select("lang", "text", "fitting")
    counts = rows.where("fitting").select("lang", "text").mapInArrow(_count, "lang string, n byte, gram long, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    counts = counts.toPandas()
    if counts.empty:
        return None, np.zeros(0)
    model = Model(counts)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def own(batches):
        m = shared.value
        for b in batches:
            ok = [(x, t) for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if x in m.langs and has_letter(t)]
            if ok:
                e = m.entropies([t for _, t in ok])
                at = [m.langs.index(x) for x, _ in ok]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ok]), pa.array(e[np.arange(len(ok)), at])], names=["lang", "bits"])

    cut = rows.where("not fitting").select("lang", "text").mapInArrow(own, "lang string, bits double").groupBy("lang").agg(F.percentile("bits", F.lit(PASS_SHARE)).alias("cut")).collect()
    by = {r["lang"]: r["cut"] for r in cut}
    return model, np.array([by.get(x, np.inf) for x in model.langs])


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_char, rejected) of every row.

    A null text and a text without a letter are 'und' with score 0 and rejected, as is everything if no
    row can be learned from. Very long texts are read whole. Of languages with equal entropies the first by name wins. held_out is false for a null doc_id. Rows that repeat give the same
    prediction; an empty table gives an empty table; other columns are ignored."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fitted(docs))

    def run(batches):
        model, cuts = shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            pred, score, bits, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), dtype=bool)
            able = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            while able:
                now, size = [], 0
                while able and (not now or size < CHUNK_CHARS):
                    size += len(texts[able[-1]])
                    now.append(able.pop())
                e = model.entropies([texts[i] for i in now])
                best = e.argmin(axis=1)
                s = confidence(e, np.array([len(texts[i]) for i in now]))
                for j, i in enumerate(now):
                    k = best[j]
                    pred[i], score[i], bits[i], rejected[i] = model.langs[k], s[j], e[j, k], e[j, k] > cuts[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred), pa.array(score), pa.array(bits, mask=np.isnan(bits)), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected"])

    d = plain(docs, "doc_id", "text").select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
