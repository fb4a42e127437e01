"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

A window can only repeat if its anchor, the least hash of the 8-word runs inside it, repeats too, as
equal windows have equal anchors. So anchors are counted first (a few per hundred words), and windows are counted and
compared in Spark only where the anchor occurs in two documents or more; no repeated window is lost by
this, and windows elsewhere are not sent. They are compared by hashes to two bases, 96 bits in all. What repeats among the SETTLED windows that a task gathers is settled there, so a
passage in very many documents goes on once for each such lot, not for each document. Repeated windows then merge into
maximal intervals of words, document by document."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import words as W
from evidara.llm.session import few, free_name, plain, prepare, table
from evidara.plans.storage import staged

WINDOW, RUN = 50, 8
#: Up to so many repeated ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _windows(w: W.Words, window: int, run: int):
    """For each document: index of its first window in the flat arrays, count of windows, and the flat anchors."""
    h = w.hashes()
    anchors = W.sliding_min(W.rolling(h, run), window - run + 1)
    count = np.maximum(np.diff(w.first) - window + 1, 0)
    return h, anchors, count


def _anchors(window: int, run: int):
    def go(batches):
        for b in W.chunks(batches, "text"):
            w = W.layout(b.column("text"))
            _, anchors, count = _windows(w, window, run)
            out, owner = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for d in np.flatnonzero(count):
                out.append(np.unique(anchors[w.first[d] : w.first[d] + count[d]]))
                owner.append(np.full(len(out[-1]), d, dtype=np.int64))
            at = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), b.column("doc_id").take(at), b.column("version").take(at)], names=["anchor", "doc_id", "version"])

    return go


#: Windows that a task gathers before it settles what repeats among them, and windows of a bucket, about.
SETTLED, BUCKET = 1 << 20, 500_000


DEALT = "bucket long, docs array<long>, versions array<long>, codes binary, places array<int>"


def _settled(g: np.ndarray, g2: np.ndarray, k: np.ndarray, p: np.ndarray, ids: np.ndarray, versions: np.ndarray, bits: int) -> pa.RecordBatch:
    """What repeats among these windows of documents ``k`` is found at once: a row of places for each document. The smallest document's windows, and those
    that occur once, are dealt to buckets by their hash, many to a row: seven bytes and four of the hashes, two for the document by its place in ``docs``, four for the place."""
    o = ids[k]
    order = np.lexsort((o, g2, g))
    g, g2, k, p, o = g[order], g2[order], k[order], p[order], o[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])
    known = o > o[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
    out = []
    mine = np.lexsort((p[known], k[known]))
    whose, places = k[known][mine], p[known][mine]
    for lo, hi in W.runs(whose):
        d = whose[lo]
        out.append((int(ids[d]) & ((1 << bits) - 1), [ids[d]], [versions[d]], None, places[lo:hi]))
    g, g2, k, p = g[~known], g2[~known], k[~known], p[~known]
    order, bucket, seven = W.bucketed(g, bits)
    g2, k, p = g2[order].astype("<u4"), k[order], p[order].astype("<u4")
    for lo, hi in W.runs(bucket):
        docs, place = np.unique(k[lo:hi], return_inverse=True)
        codes = b"".join(x.tobytes() for x in (seven[lo:hi], g2[lo:hi], p[lo:hi], place.astype("<u2")))
        out.append((int(bucket[lo]), ids[docs], versions[docs], codes, None))
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["bucket", "docs", "versions", "codes", "places"])


def _candidates(window: int, run: int, bits: int):
    """Two hashes and the place of each window whose anchor is shared, settled and dealt."""

    def go(batches):
        held, ids, versions, size = [], [], [], 0

        def lot():
            return _settled(*(np.concatenate(x) for x in zip(*held, strict=True)), np.array(ids, dtype=np.int64), np.array(versions, dtype=np.int64), bits)

        for b in W.chunks(W.unsqueezed(batches), "text"):
            w = W.layout(b.column("text"))
            h, anchors, count = _windows(w, window, run)
            r, r2 = W.rolling(h, window), W.rolling(h, window, 1)
            doc, version, shared = b.column("doc_id").to_pylist(), b.column("version").to_pylist(), b.column("anchors")
            for d in np.flatnonzero(count):
                first, n = int(w.first[d]), int(count[d])
                mine = np.unique(shared[int(d)].values.to_numpy(zero_copy_only=False).view(np.uint64))
                a = anchors[first : first + n]
                hit = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, a), len(mine) - 1)] == a)
                held.append((r[first + hit], (r2[first + hit] >> np.uint64(32)).astype(np.uint32), np.full(len(hit), len(ids), dtype=np.int32), hit.astype(np.int32)))
                ids.append(doc[d])
                versions.append(version[d])
                size += len(hit)
            if size >= SETTLED or len(ids) > 50_000:
                yield lot()
                held, ids, versions, size = [], [], [], 0
        if ids:
            yield lot()
        W.give_back()

    return go


def _repeated(t: pa.Table) -> pa.Table:
    """(doc_id, version, places) of the windows of one bucket that also start in a document with a smaller id; what was found before passes through."""
    g, g2, p, o, v = ([np.zeros(0, dtype=kind)] for kind in (np.uint64, np.uint32, np.uint32, np.int64, np.int64))
    doc, version, places = [], [], []
    for b in t.to_batches():
        docs, versions, codes, found = (b.column(c) for c in ("docs", "versions", "codes", "places"))
        for i in range(b.num_rows):
            ids, of = docs[i].values.to_numpy(), versions[i].values.to_numpy()
            if not codes[i].is_valid:
                doc.append(ids[0]), version.append(of[0]), places.append(found[i].values.to_numpy())
                continue
            raw = np.frombuffer(codes[i].as_buffer(), dtype=np.uint8)
            n = len(raw) // 17
            g.append(W.from_seven(raw[: 7 * n]))
            g2.append(np.frombuffer(raw[7 * n : 11 * n].tobytes(), dtype="<u4"))
            p.append(np.frombuffer(raw[11 * n : 15 * n].tobytes(), dtype="<u4"))
            place = np.frombuffer(raw[15 * n :].tobytes(), dtype="<u2")
            o.append(ids[place]), v.append(of[place])
    g, g2, p, o, v = (np.concatenate(x) for x in (g, g2, p, o, v))
    order = np.lexsort((o, g2, g))
    g, g2, o = g[order], g2[order], o[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (g2[1:] != g2[:-1])
    again = order[o > o[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]] if len(g) else order
    o = o[np.argsort(order)][again]  # back in the order of v and p
    v, p = v[again], p[again]
    by = np.lexsort((p, v, o))
    o, v, p = o[by], v[by], p[by].astype(np.int32)
    for lo, hi in W.runs(o):
        for a, z in W.runs(v[lo:hi]):
            doc.append(o[lo]), version.append(v[lo + a]), places.append(p[lo + a : lo + z])
    W.give_back()
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "version": pa.array(version, pa.int64()), "places": pa.array(places, pa.list_(pa.int32()))})


def _remove(window: int, keep_text: bool):
    """Counts, digest of the kept words, removed intervals as word positions, and the text that is left."""

    def go(batches):
        for b in W.chunks(W.unsqueezed(batches), "text"):
            w = W.layout(b.column("text"))
            places = b.column("places")
            valid = b.column("text").is_valid().to_numpy(zero_copy_only=False)
            n_words, n_removed, sha, starts, ends, left = [], [], [], [], [], []
            for d in range(b.num_rows):
                first, n, raw = int(w.first[d]), int(w.first[d + 1] - w.first[d]), w.text(d)
                a = e = np.zeros(0, dtype=np.int64)
                kept, text = raw.split(), raw
                if places[d].is_valid and len(places[d].values):
                    p = np.unique(places[d].values.to_numpy(zero_copy_only=False).astype(np.int64))
                    new = np.flatnonzero(np.diff(p) > window)
                    a, e = p[np.concatenate([[0], new + 1])], p[np.concatenate([new, [len(p) - 1]])] + window
                    base = int(w.offsets[d])
                    words, kept, pieces, was, at = kept, [], [], 0, 0
                    for x, y in zip(a.tolist(), e.tolist(), strict=True):
                        kept += words[was:x]
                        pieces.append(raw[at : int(w.start[first + x]) - base])
                        was, at = y, int(w.end[first + y - 1]) - base
                    kept += words[was:]
                    text = b"".join([*pieces, raw[at:]])
                n_words.append(n)
                n_removed.append(int((e - a).sum()))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                starts.append(a.astype(np.int32))
                ends.append(e.astype(np.int32))
                left.append(text.decode("utf-8") if valid[d] and keep_text else None)
            columns = [b.column("doc_id"), b.column("version"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            columns += [pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))]
            names = ["doc_id", "version", "n_words", "n_removed", "kept_sha256", "starts", "ends"]
            if keep_text:
                columns, names = [*columns, pa.array(left, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return go


def versions(docs: DataFrame) -> DataFrame:
    """``docs`` with a column more: rows that repeat a doc_id are told apart by their text's hash, all others have 0."""
    name = free_name(docs, "version")
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    twice = staged(twice, "twice")
    if twice.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    ids = twice.select(F.col("doc_id").alias(free_name(docs, "twice")))
    joined = docs.join(few(ids, BROADCAST_IDS), docs["doc_id"] == F.col(ids.columns[0]), "left")
    return joined.withColumn(name, F.when(F.col(ids.columns[0]).isNull(), F.lit(0)).otherwise(F.xxhash64("text")).cast("long")).drop(ids.columns[0])


def repeated_places(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc_id, version, places): starts of the windows that also start in a document with a smaller doc_id."""
    docs = docs.where("doc_id is not null and text is not null")
    anchors = staged(docs.mapInArrow(_anchors(window, run), "anchor long, doc_id long, version long"), "anchors")
    bits = max(8, (anchors.count() * (window - run) // 2 // BUCKET).bit_length())  # an anchor stands for so many windows
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    held = anchors.join(shared, "anchor", "left_semi").groupBy("doc_id", "version").agg(F.collect_list("anchor").alias("anchors"))
    found = W.squeeze(docs).join(held, ["doc_id", "version"]).mapInArrow(_candidates(window, run, bits), DEALT)
    found = found.groupBy("bucket").applyInArrow(_repeated, "doc_id long, version long, places array<int>")
    return found.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("places")).alias("places"))


def _cut(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """The result for each row of ``docs`` (doc_id, version, text)."""
    schema = "doc_id long, version long, n_words long, n_removed long, kept_sha256 string, starts array<int>, ends array<int>" + ", kept_text string" * keep_text
    joined = W.squeeze(docs).join(repeated_places(docs, window), ["doc_id", "version"], "left").select("doc_id", "version", "z", "places")
    return joined.mapInArrow(_remove(window, keep_text), schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, starts and ends of the removed intervals, and kept_text if asked for.

    Null texts have no words (kept_text stays null); texts of fewer words than a window lose none. Of rows that repeat
    a doc_id each is judged by its own text, and none is removed because of another with that doc_id. A null doc_id has no order, so such rows keep all words. An empty table gives an
    empty table; other columns are ignored."""
    prepare(docs.sparkSession)
    return _cut(versions(plain(docs, "doc_id", "text")), window, keep_text).drop("version")


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated passages cut from their texts; n_chars follows. Every row stays, rows that repeat a doc_id too."""
    prepare(docs.sparkSession)
    rows = versions(docs)
    version = rows.columns[-1]
    found = _cut(rows.select("doc_id", F.col(version).alias("version"), "text"), window, True).where("n_removed > 0").select("doc_id", "version", "kept_text").dropDuplicates(["doc_id", "version"])
    ident, cut, left = (free_name(rows, n) for n in ("cut_id", "cut_version", "kept_text"))
    found = found.toDF(ident, cut, left)
    d = rows.join(found, (rows["doc_id"] == F.col(ident)) & (rows[version] == F.col(cut)), "left")
    text = F.coalesce(F.col(left), F.col("text"))
    cols = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text.alias("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col(ident).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars")
    return d.select(*[cols[c] for c in docs.columns])


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
lo AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN lo USING (g) WHERE doc_id > lo.lo),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
cut AS (SELECT DISTINCT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY words.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
