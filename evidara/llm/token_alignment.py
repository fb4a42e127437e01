"""Alignment of two tokenizers: the byte offsets where tokens of both end cut them into groups.

Tokens of a byte range make a *fragment*: an open prefix (tokens up to the first common end), closed groups, and an
open suffix (tokens after the last common end). Fragments of neighbouring ranges compose, and composing is associative, so a
very long document is encoded and aligned by many tasks and its fragments meet in a tree of shuffles.

Texts are encoded in *units*: a unit begins at a space that follows a character other than white space. Neither
tokenizer has a token over such a place (the byte-level one splits there before merging; the piece vocabulary has
no piece with a space after another character, which is checked), so units encode alone as they do in the text, and each distinct
unit of a batch is encoded once."""

from __future__ import annotations

import functools
import hashlib
import json
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.session import few, plain, prepare, table
from evidara.llm.words import give_back
from evidara.plans.storage import staged

#: Texts over this many bytes are cut, where units begin, into stretches that tasks encode apart.
STRETCH_BYTES = 1 << 20
#: Fragments are made of byte ranges of this size inside a stretch.
RANGE_BYTES = 1 << 16
#: Fragments of a document that meet in one group at each level of the tree.
FAN = 8
#: Texts encoded together; about 30 bytes of memory for each byte.
BATCH_BYTES = 1 << 23
#: Distinct units are encoded in texts of about this size.
TEXT_BYTES = 1 << 12
#: Up to so many id pairs (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
#: Id pairs are coded a * PAIR + b in 31 bits.
PAIR = 1 << 15
NOTHING, SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())


@dataclass
class Tokenizers:
    """Both tokenizers with the bytes of every token."""

    a: object
    b: object
    bytes_a: pa.LargeBinaryArray
    bytes_b: pa.LargeBinaryArray
    blank: int

    def __post_init__(self):
        self.length_a, self.length_b = (pc.binary_length(x).to_numpy() for x in (self.bytes_a, self.bytes_b))
        a, b = len(self.bytes_a), len(self.bytes_b)
        if b > PAIR or a * PAIR > 1 << 31:
            raise ValueError("the vocabularies are too large for 31-bit id pairs")
        # Ids as text with the mark that follows them, for either side: inside it, or at its end.
        self.text_a, self.text_b = (pa.array([f"{i}{mark}".encode() for mark in (",", end) for i in range(n)], pa.large_binary()) for n, end in ((a, "|"), (b, ";")))


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def load(path_a: str, path_b: str) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    of = _byte_level()
    tokens_a = [b""] * a.get_vocab_size()
    with open(path_a, encoding="utf-8") as f:
        for token, i in json.load(f)["model"]["vocab"].items():
            tokens_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("a piece holds a space after another character: units would not encode alone")
    tokens_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Tokenizers(a, b, pa.array(tokens_a, pa.large_binary()), pa.array(tokens_b, pa.large_binary()), b.piece_to_id("▁"))


def paths(a: str | None = None, b: str | None = None) -> tuple[str, str]:
    """The vocabulary files; by default those of the installed public tokenizers."""
    if a and b:
        return a, b
    import public_tokenizers

    return a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")


def _buffer(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a large binary or string array without nulls."""
    offsets = np.frombuffer(x.buffers()[1], dtype=np.int64)[x.offset : x.offset + len(x) + 1]
    raw = x.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a unit begins: a text's beginning, or a space after a visible ASCII character or a two-byte letter.

    (Two-byte characters from U+00C0 on are no white space; after other characters no unit begins, which only makes it longer.)"""
    begins = np.zeros(len(data) + 1, dtype=bool)
    if len(data):
        ascii_ = (data > 0x20) & (data < 0x7F)
        second = (data >= 0x80) & (data < 0xC0)
        second[0] = False
        second[1:] &= (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        begins[1:-1] = (data[1:] == 0x20) & (ascii_ | second)[:-1]
    begins[offsets] = True
    return np.flatnonzero(begins[:-1])


def _ids(units: pa.Array, size: np.ndarray, length: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units on end, and where each unit begins there.

    Units after which another may begin are encoded many to a text, and told apart by the bytes of their tokens;
    others, and those of a text whose tokens do not give back its bytes, are encoded alone."""
    data, offsets = _buffer(units)
    last, before = data[offsets[1:] - 1], data[np.maximum(offsets[1:] - 2, 0)]
    apart = ~(((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (last < 0xC0) & (before >= 0xC3) & (before < 0xE0)))
    cuts = np.unique(np.concatenate([[0, len(size)], np.flatnonzero(apart), np.flatnonzero(apart) + 1, np.flatnonzero(np.diff(offsets[1:] // TEXT_BYTES)) + 1]))
    n = np.zeros(len(size), dtype=np.int64)
    out = []
    for lo, hi, ids in zip(cuts[:-1].tolist(), cuts[1:].tolist(), encode([data[offsets[i] : offsets[j]].tobytes().decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]), strict=True):
        ends = np.cumsum(length[ids])
        at = np.searchsorted(ends, offsets[lo + 1 : hi + 1] - offsets[lo])
        if hi - lo > 1 and not (len(ends) and at[-1] == len(ends) - 1 and (ends[at] == offsets[lo + 1 : hi + 1] - offsets[lo]).all()):
            alone = encode(units[lo:hi].to_pylist())
            n[lo:hi] = [len(x) for x in alone]
            out += alone
        else:
            n[lo:hi] = np.diff(np.concatenate([[-1], at])) if hi - lo > 1 else len(ids)
            out.append(ids)
    return np.concatenate([np.zeros(0, dtype=np.int64), *out]).astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def _spread(values: np.ndarray, first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists ``codes`` names, on end, and where each list begins there."""
    n = first[codes + 1] - first[codes]
    at = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(first[codes] - at[:-1], n) + np.arange(at[-1])], at


class Encoded:
    """Ids of every distinct unit of some texts; ``codes[first[d]:first[d + 1]]`` are text d's units.

    ``ok`` says of each text whether the bytes of its tokens are those of the text, on both sides."""

    def __init__(self, t: Tokenizers, texts: pa.Array):
        spaced = pc.binary_join_element_wise(NOTHING, texts.cast(pa.large_string()), SPACE)
        data, offsets = _buffer(spaced)
        starts = unit_starts(data, offsets)
        cuts = np.concatenate([starts, [len(data)]]).astype(np.int64)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)])
        coded = units.dictionary_encode()
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.first = np.searchsorted(starts, offsets)
        distinct = coded.dictionary.cast(pa.large_string())
        size = pc.binary_length(distinct).to_numpy().astype(np.int64)
        self.a, self.first_a = _ids(distinct, size, t.length_a, lambda texts: [np.array(e.ids) for e in t.a.encode_batch(texts, add_special_tokens=False)])
        self.b, self.first_b = _ids(distinct, size, t.length_b, lambda texts: [np.array(x) if w != " " else np.array([t.blank]) for w, x in zip(texts, t.b.encode([w[1:] for w in texts], num_threads=1), strict=True)])
        same = self._same(t.bytes_a, t.length_a, self.a, self.first_a, distinct, size) & self._same(t.bytes_b, t.length_b, self.b, self.first_b, distinct, size)
        bad = np.concatenate([[0], np.cumsum(~same[self.codes])])
        self.ok = (bad[self.first[1:]] == bad[self.first[:-1]]) & (np.diff(offsets) > 1)

    @staticmethod
    def _same(tokens: pa.LargeBinaryArray, length: np.ndarray, ids: np.ndarray, first: np.ndarray, units: pa.Array, size: np.ndarray) -> np.ndarray:
        """Which units the bytes of their tokens give back."""
        total = np.concatenate([[0], np.cumsum(length[ids])])
        out = total[first[1:]] - total[first[:-1]] == size
        right = np.flatnonzero(out)
        got, _ = _buffer(tokens.take(pa.array(_spread(ids, first, right)[0])))
        want, at = _buffer(units.take(pa.array(right)))
        wrong = np.concatenate([[0], np.cumsum(got != want)])
        out[right] = wrong[at[1:]] == wrong[at[:-1]]
        return out

    def tokens(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text d on both sides."""
        codes = self.codes[self.first[d] : self.first[d + 1]]
        return _spread(self.a, self.first_a, codes)[0], _spread(self.b, self.first_b, codes)[0]


def common(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of either side end where one of the other does; ends ascend."""
    if not len(end_a) or not len(end_b):
        return np.zeros(len(end_a), dtype=bool), np.zeros(len(end_b), dtype=bool)
    low = min(end_a[0], end_b[0])
    seen = np.zeros((2, max(end_a[-1], end_b[-1]) - low + 1), dtype=bool)
    seen[0, end_a - low] = True
    seen[1, end_b - low] = True
    return seen[1, end_a - low], seen[0, end_b - low]


def grouped(t: Tokenizers, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> pa.Array:
    """Whole groups as text, a token an entry: ``a1,a2|b1;``. ``last_*`` mark the tokens that end a group."""
    group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=1))])[group_a]
    before_a = np.cumsum(np.bincount(group_a, minlength=1))[group_b]
    na = len(t.bytes_a)
    out = np.zeros(len(a) + len(b), dtype=np.int64)
    out[np.arange(len(a)) + before_b] = a + na * last_a
    out[np.arange(len(b)) + before_a] = 2 * na + b + len(t.bytes_b) * last_b
    return pa.concat_arrays([t.text_a, t.text_b]).take(pa.array(out)) if len(out) else pa.array([], pa.large_binary())


@dataclass
class Fragment:
    """Tokens of a byte range. Without a common end (``groups`` is None) all of them are in the prefix."""

    a: np.ndarray
    b: np.ndarray
    groups: bytes | None = None
    pairs: np.ndarray | None = None
    tail_a: np.ndarray | None = None
    tail_b: np.ndarray | None = None

    def __add__(self, other: Fragment) -> Fragment:
        if self.groups is None:
            return Fragment(np.concatenate([self.a, other.a]), np.concatenate([self.b, other.b]), other.groups, other.pairs, other.tail_a, other.tail_b)
        a, b = np.concatenate([self.tail_a, other.a]), np.concatenate([self.tail_b, other.b])
        if other.groups is None:
            return Fragment(self.a, self.b, self.groups, self.pairs, a, b)
        return Fragment(self.a, self.b, self.groups + group(a, b) + other.groups, np.concatenate([self.pairs, link(a, b), other.pairs]), other.tail_a, other.tail_b)

    def closed(self) -> tuple[bytes, np.ndarray]:
        """Groups and linked pairs of a whole document, where both sides end together."""
        return group(self.a, self.b) + self.groups, np.concatenate([link(self.a, self.b), self.pairs])


def group(a: np.ndarray, b: np.ndarray) -> bytes:
    return f"{','.join(map(str, a.tolist()))}|{','.join(map(str, b.tolist()))};".encode()


def link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([a[-1] * PAIR + b[-1]], dtype=np.int64)


def fragment(t: Tokenizers, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> Fragment:
    """The fragment of the tokens whose ends lie in a byte range."""
    last_a, last_b = common(end_a, end_b)
    ka, kb = np.flatnonzero(last_a), np.flatnonzero(last_b)
    if not len(ka):
        return Fragment(a, b)
    inner = (slice(ka[0] + 1, ka[-1] + 1), slice(kb[0] + 1, kb[-1] + 1))
    text, _ = _buffer(grouped(t, a[inner[0]], b[inner[1]], last_a[inner[0]], last_b[inner[1]]))
    return Fragment(a[: ka[0] + 1], b[: kb[0] + 1], text.tobytes(), a[ka[1:]] * PAIR + b[kb[1:]], a[ka[-1] + 1 :], b[kb[-1] + 1 :])


def fragments(t: Tokenizers, a: np.ndarray, b: np.ndarray, size: int = RANGE_BYTES) -> list[Fragment]:
    """Fragments of a token sequence by byte ranges, in order."""
    end_a, end_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
    cuts = np.arange(0, max(end_a[-1] if len(a) else 0, end_b[-1] if len(b) else 0) + size, size)
    ca, cb = np.searchsorted(end_a, cuts, side="right"), np.searchsorted(end_b, cuts, side="right")
    return [fragment(t, a[i:j], b[k:m], end_a[i:j], end_b[k:m]) for i, j, k, m in zip(ca[:-1], ca[1:], cb[:-1], cb[1:], strict=True)]


def tree(parts: list[Fragment]) -> Fragment:
    while len(parts) > 1:
        parts = [x + parts[i + 1] if i + 1 < len(parts) else x for i, x in enumerate(parts) if i % 2 == 0]
    return parts[0]


SHAPE = "row long, doc_id {id}, n_a long, n_b long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _counts(pairs: np.ndarray, text: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct pairs of each text and how often they occur there."""
    key, k = np.unique((text << 31) | pairs, return_counts=True)
    cut = np.searchsorted(key >> 31, np.arange(1, n))
    return np.split((key & ((1 << 31) - 1)).astype(np.int32), cut), np.split(k.astype(np.int32), cut)


def _whole(t: Tokenizers, texts: pa.Array) -> dict[str, list]:
    """Alignment of texts that fit in a batch, one closed fragment each: units end together on both sides, so they align alone."""
    e = Encoded(t, texts)
    n = len(texts)
    ok = e.ok
    codes = e.codes[np.repeat(ok, np.diff(e.first))]
    counts = np.where(ok, np.diff(e.first), 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    used = np.unique(codes)  # units of texts that have tokens
    new = np.zeros(len(e.first_a), dtype=np.int64)
    new[used] = np.arange(len(used))
    codes = new[codes]
    (a, fa), (b, fb) = _spread(e.a, e.first_a, used), _spread(e.b, e.first_b, used)
    last_a, last_b = common(np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b]))
    pairs = a[last_a] * PAIR + b[last_b]
    fl = np.concatenate([[0], np.cumsum(last_a)])[fa]
    tokens = grouped(t, a, b, last_a, last_b)
    raw, at = _buffer(tokens)
    text_at = np.ascontiguousarray(at[fa + fb])
    unit_text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(used), [None, pa.py_buffer(text_at.tobytes()), pa.py_buffer(raw)])
    out, out_at = _buffer(unit_text.take(pa.array(codes)))
    spans = out_at[first]
    view = memoryview(out)
    sha = [hashlib.sha256(view[spans[d] : spans[d + 1] - 1]).hexdigest() if ok[d] else "" for d in range(n)]
    linked, link_at = _spread(pairs, fl, codes)
    n_links = np.diff(link_at[first])
    ids, times = _counts(linked, np.repeat(np.arange(n), n_links), n)
    total = lambda f: np.diff(np.concatenate([[0], np.cumsum(np.diff(f)[codes])])[first])
    return {"n_a": total(fa), "n_b": total(fb), "n_links": n_links, "groups_sha256": sha, "pairs": ids, "times": times}


def _batches(batches, column: str, size: int = BATCH_BYTES):
    """Record batches put together, or cut, to about ``size`` bytes of text."""
    held, n = [], 0
    for b in batches:
        sizes = np.asarray(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        for i, x in enumerate(sizes.tolist()):
            n += x
            if n >= size:
                held.append(b.slice(lo, i + 1 - lo))
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, lo = [], 0, i + 1
        if lo < b.num_rows:
            held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(x: pa.ChunkedArray) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _record(columns: dict, row, ids) -> pa.RecordBatch:
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.list_(pa.int32()), "times": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([row, ids, *(pa.array(columns[c], k) for c, k in kinds.items())], names=["row", "doc_id", *kinds])


def cut(text: str, size: int = STRETCH_BYTES) -> list[str]:
    """Stretches of a text: each but the first begins a unit, without that unit's space. None is shorter than ``size`` bytes but the last."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts = unit_starts(data, np.array([0, len(data)]))
    chosen, last = [0], 0
    while (k := np.searchsorted(starts, last + size)) < len(starts):
        last = int(starts[k])
        chosen.append(last)
    return [data[lo + (lo > 0) : hi].tobytes().decode() for lo, hi in zip(chosen, [*chosen[1:], len(data)], strict=True)]


PART = "row long, doc_id {id}, part long, ok boolean, n_a long, n_b long, a array<int>, b array<int>, groups binary, pairs array<int>, tail_a array<int>, tail_b array<int>"


def _cut(frames):
    for p in frames:
        for r in p.itertuples(index=False):
            parts = cut(r.text)
            yield pd.DataFrame({"row": r.row, "doc_id": [r.doc_id] * len(parts), "part": range(len(parts)), "text": parts})


def _pack(row, ids, part, ok, n_a, n_b, f: Fragment) -> dict:
    return {"row": row, "doc_id": ids, "part": part, "ok": ok, "n_a": n_a, "n_b": n_b, "a": f.a, "b": f.b, "groups": f.groups, "pairs": f.pairs, "tail_a": f.tail_a, "tail_b": f.tail_b}


def _unpack(r) -> Fragment:
    whole = [None if x is None else np.asarray(x, dtype=np.int64) for x in (r.a, r.b, r.pairs, r.tail_a, r.tail_b)]
    return Fragment(whole[0], whole[1], None if r.groups is None else bytes(r.groups), *whole[2:])


def _long_documents(docs: DataFrame, where: tuple[str, str], kind: str) -> DataFrame:
    """Documents over STRETCH_BYTES: stretches are encoded apart, and their fragments meet FAN at a time."""
    spark = docs.sparkSession

    def encode(frames):
        t = load(*where)
        for p in frames:
            for r in p.itertuples(index=False):
                e = Encoded(t, pa.array([r.text]))
                if e.ok[0]:
                    a, b = e.tokens(0)
                    f = tree(fragments(t, a, b))
                else:
                    a = b = np.zeros(0, dtype=np.int64)
                    f = Fragment(a, b)
                yield pd.DataFrame([_pack(r.row, r.doc_id, r.part, bool(e.ok[0]), len(a), len(b), f)])
            give_back()

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("part")
        f = tree([_unpack(r) for r in p.itertuples(index=False)])
        return pd.DataFrame([_pack(p["row"].iloc[0], p["doc_id"].iloc[0], p["part"].iloc[0] // FAN, bool(p["ok"].all()), p["n_a"].sum(), p["n_b"].sum(), f)])

    def close(frames):
        for p in frames:
            for r in p.itertuples(index=False):
                text, pairs = _unpack(r).closed() if r.ok else (b"", np.zeros(0, dtype=np.int64))
                ids, times = _counts(pairs, np.zeros(len(pairs), dtype=np.int64), 1)
                sha = hashlib.sha256(text[:-1]).hexdigest() if r.ok else ""
                yield pd.DataFrame({"row": r.row, "doc_id": [r.doc_id], "n_a": r.n_a if r.ok else 0, "n_b": r.n_b if r.ok else 0, "n_links": len(pairs), "groups_sha256": sha, "pairs": ids, "times": times})

    shape = PART.format(id=kind)
    stretches = docs.mapInPandas(_cut, f"row long, doc_id {kind}, part long, text string")
    d = staged(stretches.repartition("row", "part").mapInPandas(encode, shape), "fragments")
    left = d.agg(F.max("part")).first()[0] or 0
    while left:
        d = d.groupBy("row", F.expr(f"part div {FAN}")).applyInPandas(meet, shape)
        left //= FAN
    return d.mapInPandas(close, SHAPE.format(id=kind))


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that either side's tokens do not give back, have zeros and an empty groups_sha256.
    Rows that repeat are aligned (and counted) each; ids may be null or repeat; ties of the highest count of a B id all
    count as best; very long texts are encoded whole, in stretches; an empty table gives an empty table; other columns are ignored."""
    spark = docs.sparkSession
    prepare(spark)
    where, kind = paths(path_a, path_b), "string"
    d = plain(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    long_ = F.octet_length("text") > STRETCH_BYTES

    def run(batches):
        t = load(*where)
        for b in _batches(batches, "text"):
            yield _record(_whole(t, _one(b.column("text")).fill_null("")), _one(b.column("row")), _one(b.column("doc_id")))
            give_back()

    short = d.where(~F.coalesce(long_, F.lit(False))).mapInArrow(run, SHAPE.format(id=kind))
    found = staged(short.unionByName(_long_documents(d.where(long_), where, kind)), "alignments")
    pairs = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = staged(counts, "pairs").withColumn("b", F.col("pair") % PAIR)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # one row per B id
    counts = counts.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    sums = pairs.join(few(counts, BROADCAST_PAIRS), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.join(sums, "row", "left").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
