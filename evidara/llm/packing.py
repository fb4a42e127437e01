"""Lexical retrieval packing: a sharded BM25 inverted index supplies unused neighbours for each seed document.

Terms are token ids, so document frequencies are one bounded vector (the vocabulary of the tokenizer),
counted over all documents. Documents are dealt to shards of about SHARD_TOKENS tokens by their content: a
tree of planes, fitted on a sample, parts them so that alike documents meet in a shard; each shard has
its own inverted index, and a seed asks that of its own shard. A sequence starts with a seed and is filled with the best unused
neighbours; the one that does not fit is cut and its rest is the next seed, so that only the end of a
shard is not full, and that end is cut at powers of two, which need no padding."""

from __future__ import annotations

import json
import math
import os
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import words as W
from evidara.llm.session import plain, prepare, table
from evidara.plans.storage import staged

WINDOW, END_ID, SHARD_TOKENS = 4096, 2, 600_000
K1, B = 1.2, 0.75
#: A longer document enters the index as several units of this many tokens.
UNIT_TOKENS = 16 * WINDOW
#: For the planes, terms are hashed to so many signed dimensions; units in the sample for each shard, and at most.
DIMENSIONS, SAMPLE_PER_SHARD, SAMPLE = 128, 64, 32_768
#: A leaf of the tree with more than so many times SHARD_TOKENS, such as one of very many copies, is dealt to several shards by a hash.
OVERFULL = 1.5


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file, by the module that describes the public tokenizers, from $PUBLIC_TOKENIZERS or its usual place."""
    import importlib.util

    home = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        return os.path.join(home, name)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.path(name)


_LETTER, _MARK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?#*$%&()-")] = True


def apart(w: W.Words) -> W.Words:
    """Words cut between an ASCII letter and one of the marks above, as the tokenizer cuts there too; apostrophes and the marks of special tokens stay."""
    letter, mark = _LETTER[w.data], _MARK[w.data]
    cut = np.flatnonzero(letter[:-1] & mark[1:] | mark[:-1] & letter[1:]) + 1
    inner = cut[~np.isin(cut, w.offsets)]
    start, end = np.sort(np.concatenate([w.start, inner])), np.sort(np.concatenate([w.end, inner]))
    return W.Words(w.data, w.offsets, start, end, np.searchsorted(start, w.offsets))


class WordTokenizer:
    """Token ids of whole texts through a table of words: this tokenizer never joins over ASCII white space, so each word is encoded once."""

    #: Words kept; beyond it the table starts anew. About 50 bytes each.
    LIMIT = 600_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), dtype=bool)  # ids of pieces' last tokens
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.keys, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.lens, self.starts, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, tokens of each word) of words.

        Lower-case words of letters alone are one piece for the tokenizer and pass its normalizer unchanged, so many of
        them are encoded as one line, and the ids that end a piece tell them apart. All others go through the whole tokenizer, each by itself."""
        simple = np.array([x.isalpha() and x.islower() and (x.isascii() or unicodedata.is_normalized("NFC", x)) for x in texts], dtype=bool)
        at = np.flatnonzero(simple)
        lines = [" ".join([texts[i] for i in at[k : k + 500].tolist()]) for k in range(0, len(at), 500)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)), dtype=np.int32)
        ends = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, dtype=np.int64)
        if len(ends) != len(at):
            simple[:], at, ids, ends = False, at[:0], ids[:0], ends[:0]
        rest = np.flatnonzero(~simple)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False)]
        lens = np.zeros(len(texts), dtype=np.int64)
        lens[at], lens[rest] = np.diff(ends, prepend=0), [len(i) for i in others]
        source = np.concatenate([ids, np.fromiter(chain.from_iterable(others), dtype=np.int32)])
        begin = np.zeros(len(texts), dtype=np.int64)
        begin[at], begin[rest] = ends - lens[at], len(ids) + np.cumsum(lens[rest]) - lens[rest]
        return source[np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))], lens

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Add words that are not in the table."""
        flat, lens = self.split(texts)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.place = np.insert(self.place, at, len(self.lens) + order)
        self.keys = np.insert(self.keys, at, keys[order])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, flat])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the table, -1 where it has none."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def encode(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, tokens of each word)."""
        code, uniq = pd.factorize(w.hashes())
        if not len(code):
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        if len(self.keys) > self.LIMIT:
            self.reset()
        known = self.find(uniq)
        if (new := np.flatnonzero(known < 0)).size:
            first = np.zeros(len(uniq), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            self.learn(uniq[new], [w.data[w.start[i] : w.end[i]].tobytes().decode("utf-8") for i in first[new].tolist()])
            known = self.find(uniq)
        at = known[code]
        n = self.lens[at]
        begin = np.cumsum(n) - n
        return self.flat[np.repeat(self.starts[at] - begin, n) + np.arange(int(n.sum()))], n


_TOKENIZERS: dict[str, WordTokenizer] = {}


def lowered(texts: pa.Array) -> W.Words:
    """Words in lower case, as the tokenizer does anyway, but for those with a mark of special tokens, which it looks for in the text as it is."""
    w = W.layout(texts)
    low = W.LOWER[w.data]
    marks = np.flatnonzero((w.data[:-1] == ord("<")) & (w.data[1:] == ord("|")))
    for i in np.unique(np.searchsorted(w.start, marks, side="right") - 1).tolist():
        low[w.start[i] : w.end[i]] = w.data[w.start[i] : w.end[i]]
    return W.Words(low, w.offsets, w.start, w.end, w.first)


def _tokens(path: str):
    def run(batches):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = WordTokenizer(path)
        t = _TOKENIZERS[path]
        for b in W.chunks(batches, "text"):
            w = apart(lowered(b.column("text")))
            flat, n = t.encode(w)
            ends = np.concatenate([[0], np.cumsum(n)])[w.first]
            end = np.array([END_ID], dtype=np.int32)
            ids = [np.concatenate([flat[ends[d] : ends[d + 1]], end]) for d in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return run


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids as little-endian unsigned 32-bit numbers, n_tokens), the end id included; a null text has the end id alone."""
    prepare(docs.sparkSession)
    return plain(docs, "doc_id", "text").mapInArrow(_tokens(path), "doc_id long, ids binary, n_tokens long")


def _frequencies(size: int):
    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column("ids"):
                total[np.unique(np.frombuffer(x.as_buffer(), dtype="<u4"))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])
        W.give_back()

    return run


class Index:
    """BM25 postings of one shard: ``of(unit)`` are the scores of all units for that unit's terms."""

    def __init__(self, units: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = len(units)
        lens = np.array([len(u) for u in units], dtype=np.int64)
        keys, tf = np.unique(np.repeat(np.arange(n), lens) * len(idf) + np.concatenate(units), return_counts=True)
        unit, term = keys // len(idf), keys % len(idf)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[unit] / mean_length))
        self.n, self.term = n, term
        self.bounds = np.searchsorted(unit, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.post_unit, self.post_weight = unit[order], weight[order]
        self.post_bounds = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def of(self, unit: int) -> np.ndarray:
        terms = self.term[self.bounds[unit] : self.bounds[unit + 1]]
        lo, hi = self.post_bounds[terms], self.post_bounds[terms + 1]
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(self.post_unit[at], weights=self.post_weight[at], minlength=self.n)


def fill(units: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (unit, start, length). Seeds come in order; ties in score go to the earlier unit."""
    index = Index(units, idf, mean_length)
    unused = np.ones(len(units), dtype=bool)
    sequences, room, now = [], window, []
    queue: list[int] = []
    seed = 0

    def put(unit: int) -> None:
        nonlocal room, now, queue
        start, n = 0, len(units[unit])
        unused[unit] = False
        while start < n:
            take = min(room, n - start)
            now.append((unit, start, take))
            start, room = start + take, room - take
            if room == 0:
                sequences.append(now)
                now, room, queue = [], window, []
                if start < n:
                    queue = neighbours(unit)

    def neighbours(unit: int) -> list[int]:
        scores = np.where(unused, index.of(unit), 0.0)
        many = min(len(scores), 64)
        best = np.argpartition(-scores, many - 1)[:many]
        best = best[scores[best] > 0]
        return best[np.lexsort((best, -scores[best]))][::-1].tolist()

    while True:
        while queue and not unused[queue[-1]]:
            queue.pop()
        if queue:
            put(queue.pop())
            continue
        if now:  # all neighbours that were found are used: the last document asks next
            queue = neighbours(now[-1][0])
            if queue:
                continue
        while seed < len(units) and not unused[seed]:
            seed += 1
        if seed == len(units):
            break
        if not now:
            unused[seed] = False
            queue = neighbours(seed)
            unused[seed] = True
        kept = queue
        put(seed)
        queue = queue or (kept if now else [])
    if now:
        sequences += powers_of_two(now)
    return sequences


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut the pieces of an unfinished sequence into sequences whose lengths are powers of two, longest first."""
    total, out, pieces = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while total:
        size = 1 << (total.bit_length() - 1)
        total, now = total - size, []
        while size:
            unit, start, n = pieces.pop()
            take = min(n, size)
            now.append((unit, start, take))
            size -= take
            if take < n:
                pieces.append((unit, start + take, n - take))
        out.append(now)
    return out


def _pack(shared, mean_length: float, window: int):
    def run(t: pa.Table) -> pa.Table:
        _TOKENIZERS.clear()  # the worker may have encoded before; its word table is not needed now
        ids, raw, base, total = (t.column(c).to_pylist() for c in ("doc_id", "ids", "base", "n_tokens"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, base[i], raw[i]))
        units = [np.frombuffer(raw[i], dtype="<u4").astype(np.int64) for i in order]
        shard = t.column("shard")[0].as_py()
        rows = []
        for s, pieces in enumerate(fill(units, shared.value, mean_length, window)):
            offset = 0
            for unit, start, n in pieces:
                i = order[unit]
                rows.append((ids[i], base[i] + start, n, zlib.crc32(raw[i][4 * start : 4 * (start + n)]), total[i], (shard << 32) + s, offset))
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out = pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)})
        del units, raw, rows
        W.give_back()
        return out

    return run


def _units(size: int):
    def run(batches):
        for b in batches:
            out = [(b.column("doc_id")[i].as_py(), x[4 * a : 4 * (a + size)], a, len(x) // 4) for i, x in enumerate(b.column("ids").to_pylist()) for a in range(0, len(x) // 4, size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())], names=["doc_id", "ids", "base", "n_tokens"])

    return run


def directions(units: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of the units: each token adds its squared idf, with a sign, to the dimension its id is hashed to."""
    mixed = (np.arange(len(idf), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    place, sign = (mixed % np.uint64(DIMENSIONS)).astype(np.int64), np.where(mixed >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *units]).astype(np.int64)
    row = np.repeat(np.arange(len(units)), [len(u) for u in units])
    v = np.bincount(row * DIMENSIONS + place[flat], weights=(sign * idf**2)[flat], minlength=len(units) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


class Planes:
    """A tree of planes with ``leaves`` leaves of about equal weight; each plane is across the main axis of the sample in its node."""

    def __init__(self, vectors: np.ndarray, weight: np.ndarray, leaves: int):
        self.axis, self.at, self.child, self.leaves = [], [], [], 0
        self.root = self.grow(vectors, weight, leaves)
        self.axis = np.array(self.axis).reshape(-1, DIMENSIONS)
        self.at, self.child = np.array(self.at), np.array(self.child, dtype=np.int64).reshape(-1, 2)

    def grow(self, v: np.ndarray, weight: np.ndarray, leaves: int) -> int:
        """Number of the node; leaves have -1, -2 and so on."""
        if leaves > 1 and len(v) > 1:
            axis = np.linalg.eigh(np.cov(v, rowvar=False, aweights=weight))[1][:, -1]
            x = v @ axis
            order = np.argsort(x, kind="stable")
            part = np.cumsum(weight[order])
            cut = x[order][min(int(np.searchsorted(part, part[-1] * (leaves // 2) / leaves)), len(x) - 2)]
            left = x <= cut
            if not left.all():
                me = len(self.axis)
                self.axis.append(axis), self.at.append(cut), self.child.append(None)
                self.child[me] = (self.grow(v[left], weight[left], leaves // 2), self.grow(v[~left], weight[~left], leaves - leaves // 2))
                return me
        self.leaves += 1
        return -self.leaves

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            right = np.einsum("ij,ij->i", vectors[inner], self.axis[n]) > self.at[n]
            node[inner] = self.child[n, right.astype(np.int64)]
        return -node - 1


def _directions(shared):
    def run(batches):
        for b in batches:
            v = directions([np.frombuffer(x.as_buffer(), dtype="<u4") for x in b.column("ids")], shared.value)
            yield pa.RecordBatch.from_arrays([b.column("n_tokens"), pa.array([x.astype("<f4").tobytes() for x in v], pa.binary())], names=["n_tokens", "v"])

    return run


def _leaves(shared, planes):
    def run(batches):
        for b in batches:
            leaf = planes.value.leaf(directions([np.frombuffer(x.as_buffer(), dtype="<u4") for x in b.column("ids")], shared.value))
            yield b.append_column("leaf", pa.array(leaf, pa.int64()))
        W.give_back()

    return run


def dealt(units: DataFrame, shared, total: int, shard_tokens: int) -> DataFrame:
    """The units with a column ``shard``. The sample, the planes and the leaves' sizes go through the driver; their sizes are fixed or the number of shards."""
    spark = units.sparkSession
    shards = max(1, math.ceil(total / shard_tokens))
    if shards == 1:
        return units.withColumn("shard", F.lit(0).cast("long"))
    key = F.xxhash64("doc_id", "base", F.crc32("ids"))
    share = min(SAMPLE, SAMPLE_PER_SHARD * shards) / max(1, units.count())
    some = units.where(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("n_tokens", F.length("ids").cast("double") / 4)
    rows = some.mapInArrow(_directions(shared), "n_tokens double, v binary").collect()
    rows.sort(key=lambda r: (r["v"], r["n_tokens"]))
    v = np.array([np.frombuffer(r["v"], dtype="<f4") for r in rows], dtype=np.float64).reshape(-1, DIMENSIONS)
    planes = spark.sparkContext.broadcast(Planes(v, np.array([r["n_tokens"] for r in rows]), shards))
    placed = units.mapInArrow(_leaves(shared, planes), "doc_id long, ids binary, base long, n_tokens long, leaf long")
    first, parts = 0, []
    for r in sorted(placed.groupBy("leaf").agg(F.sum(F.length("ids")) / 4).collect()):  # a row per leaf
        n = math.ceil(r[1] / shard_tokens) if r[1] > OVERFULL * shard_tokens else 1
        parts.append((r[0], first, n))
        first += n
    parts = spark.createDataFrame(parts, "leaf long, first long, parts long")
    return placed.join(F.broadcast(parts), "leaf").withColumn("shard", F.col("first") + F.pmod(key, F.col("parts"))).drop("leaf", "first", "parts")


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are documents of their own, also where
    they share a doc_id. An empty table gives an empty table; other columns are ignored. The token table
    is written to the shared folder once and read for the document frequencies, to deal and to pack."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    size = 1 + max([END_ID, *known["model"]["vocab"].values(), *(x["id"] for x in known.get("added_tokens", []))])
    t = staged(tokens(docs, path), "tokens")
    n, total = t.agg(F.count("*"), F.sum("n_tokens")).first()
    n, total = n, total or 0
    df = np.zeros(size, dtype=np.int64)
    for i, c in t.mapInArrow(_frequencies(size), "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # one row per token id at most
        df[i] = c
    shared = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))
    units = t.mapInArrow(_units(UNIT_TOKENS), "doc_id long, ids binary, base long, n_tokens long")
    units = dealt(units, shared, total, shard_tokens)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return units.groupBy("shard").applyInArrow(_pack(shared, total / max(n, 1), window), schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
