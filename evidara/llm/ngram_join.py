"""N-gram Jaccard join over prefix trees of globally ordered n-gram sets.

1. Every text becomes a set of 64-bit hashes of its 5-word shingles. A set's digest groups equal sets.
2. One global order holds for all sets: rare shingles by hash, then the frequent ones (a list whose length has a proven
   bound) by hash. Of two sets with Jaccard similarity t or more, the first ``n - ceil(t n) + l`` of each have l common
   shingles. With l a quarter of the smaller set this is counted for every set, and only sets that share so much go on.
3. The shingles among the first ``n - ceil(t n) + 1`` lead each set to a pivot, the least set that shares one. All sets of a
   pivot meet in a task, many pivots to a task, and large ones in several; the links found give labels.
4. A shingle whose holders have one label is settled. The holders of each other one meet where its least label meets, and are joined once more between
   different labels; where a task cannot hold all, they are cut into parts by label, and pairs of parts are joined.

In a task the sets are stored in a trie, frequent shingles first, so that common passages are one path. A probe counts its
overlap once for each node, not for each set, and leaves a subtree as soon as the lengths that remain cannot reach the
threshold. Sets that have one label already are not compared again, which keeps components exact without
listing all pairs of a group. Links are decided on the 64-bit hashes of whole sets."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm import words as W
from evidara.llm.session import few, free_name, plain, prepare
from evidara.operators.components import connected_components
from evidara.plans.storage import staged

#: At most this many shingles are on the list of frequent ones, whatever the input: each has
#: more than (all shingles) / MAX_FREQUENT holders. 8 bytes each.
MAX_FREQUENT = 1 << 20
#: Shingles that a task meets before it counts them, and counters that it keeps.
COUNTED, COUNTERS = 1 << 19, 1 << 15
#: Shingles that a task gathers before it deals them out, and shingles of a bucket: both bound the memory of a task.
FLUSH, BUCKET = 250_000, 250_000
#: Shingles that a task joins in one trie, about; only a single text may be longer.
LIMIT = 500_000
#: Up to so many ids of candidates (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
NOBODY = np.iinfo(np.int64).min


def shingle_sets(texts: pa.Array, k: int) -> Iterable[tuple[int, np.ndarray]]:
    """(words, sorted distinct shingle hashes) of each text, A-Z in lower case."""
    w = W.layout(texts, lower=True)
    h = w.hashes()
    g = W.rolling(h, k)
    for d in range(len(texts)):
        a, z = int(w.first[d]), int(w.first[d + 1])
        n = z - a
        if n >= k:
            yield n, np.unique(g[a : z - k + 1])
        elif n:
            with np.errstate(over="ignore"):
                x = np.uint64(n)
                for y in h[a:z]:
                    x = W.mix(np.array([x * np.uint64(W.BYTE_BASE) + y], dtype=np.uint64))[0]
            yield n, np.array([x], dtype=np.uint64)
        else:
            yield 0, g[:0]


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = W.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), W.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` shingles with a similar one."""
    return -(-percent * n // 100)


def prefix_size(n: int, percent: int, common: int = 1) -> int:
    """So many of a set's first shingles hold at least ``common`` shingles of any similar set."""
    return min(n, n - least_overlap(n, percent) + common)


def counted_prefix(n: int, percent: int) -> int:
    return prefix_size(n, percent, max(1, n // 4))


def needed(n: Column, percent: int) -> Column:
    """Shingles that a set must share within the counted prefixes to have a link: a quarter of the smallest similar set."""
    return F.greatest(F.lit(1), F.floor(F.floor((n * percent + 99) / 100) / 4))


class Frequent:
    """Counts of frequent shingles in bounded space (Misra-Gries): of what comes, single ones go first, then the least of all counts is taken off."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.waiting += sets
        self.size += sum(len(s) for s in sets)
        if self.size >= COUNTED:
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        u, c = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting, self.size = [], 0
        u, c = u[c > 1], c[c > 1]
        self.keys, at = np.unique(np.concatenate([self.keys, u]), return_inverse=True)
        self.counts = np.bincount(at, weights=np.concatenate([self.counts, c]), minlength=len(self.keys)).astype(np.int64)
        if len(self.keys) > COUNTERS:
            cut = -np.partition(-self.counts, COUNTERS)[COUNTERS]
            self.keys, self.counts = self.keys[self.counts > cut], self.counts[self.counts > cut] - cut


def _profile(k: int):
    """Rows (0, doc_id, size, digest) of documents and (1, hash, count) of frequent shingles in a task."""

    def run(batches):
        seen = Frequent()
        names = ["kind", "id", "n", "d1", "d2"]
        for b in W.chunks(batches, "text"):
            sets = [s for _, s in shingle_sets(b.column("text"), k)]
            dig = np.array([_digest(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), dtype=np.int8)), b.column("doc_id"), pa.array(size), pa.array(dig[:, 0]), pa.array(dig[:, 1])], names=names)
            seen.add(sets)
        seen.fold()
        none = pa.nulls(len(seen.keys), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(seen.keys), dtype=np.int8)), pa.array(seen.keys.view(np.int64)), pa.array(seen.counts), none, none], names=names)
        W.give_back()

    return run


class Order:
    """The global order: ``of(s)`` puts a sorted set into it, rare shingles first."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.sieve = np.zeros(1 << 22, dtype=bool)
        self.sieve[(frequent & np.uint64(len(self.sieve) - 1)).astype(np.int64)] = True

    def is_frequent(self, s: np.ndarray) -> np.ndarray:
        hit = self.sieve[(s & np.uint64(len(self.sieve) - 1)).astype(np.int64)]
        if hit.any():
            at = np.flatnonzero(hit)
            hit[at] = self.frequent[np.minimum(np.searchsorted(self.frequent, s[at]), len(self.frequent) - 1)] == s[at]
        return hit

    def of(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The set in order, and how many of it are rare."""
        hot = self.is_frequent(s)
        return np.concatenate([s[~hot], s[hot]]), int(len(s) - hot.sum())


def _by_bucket(k: int, percent: int, bits: int, shared):
    """The rare shingles of counted prefixes dealt to buckets, many to a row: seven bytes that with the bucket are the whole hash, and two for
    the set, named by its digest, by its place in ``sets``.

    Frequent shingles, and those that two sets of a flush have, are shared for certain: they are only counted for their set (rows
    without codes), and of the latter one entry without a set tells the other tasks."""

    def rows(hashes: list[np.ndarray], names: list[int], known: list[int]):
        own = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        flat = np.concatenate(hashes)
        order, bucket, seven = W.bucketed(flat, bits)
        own, flat = own[order], flat[order]
        twin = np.zeros(len(flat), dtype=bool)
        twin[1:] = flat[1:] == flat[:-1]
        tell = np.zeros(len(flat), dtype=bool)
        tell[:-1] = twin[1:] & ~twin[:-1]
        twin[:-1] |= flat[1:] == flat[:-1]
        count = np.array(known) + np.bincount(own[twin], minlength=len(hashes))
        name = np.array(names, dtype=np.int64)
        keep = ~twin | tell
        whose, bucket, seven = np.where(tell, NOBODY, name[own])[keep], bucket[keep], seven[keep]
        out = [(int(name[0]) & ((1 << bits) - 1), name, None, count.astype("<u4").tobytes())]
        for lo, hi in W.runs(bucket):
            sets, place = np.unique(whose[lo:hi], return_inverse=True)
            out.append((int(bucket[lo]), sets, seven[lo:hi].tobytes() + place.astype("<u2").tobytes(), None))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["bucket", "sets", "codes", "counts"])

    def run(batches):
        order = Order(shared.value)
        hashes, names, known, size, met = [], [], [], 0, set()
        for b in W.chunks(batches, "text"):
            for _, s in shingle_sets(b.column("text"), k):
                if len(s) and (name := _digest(s)[0]) not in met:
                    met.add(name)
                    s, rare = order.of(s)
                    take = counted_prefix(len(s), percent)
                    hashes.append(s[: min(take, rare)])
                    names.append(name)
                    known.append(max(0, take - rare))
                    size += len(hashes[-1])
            if size > FLUSH or len(names) > 60_000:
                yield rows(hashes, names, known)
                hashes, names, known, size, met = [], [], [], 0, set()
        if names:
            yield rows(hashes, names, known)
        W.give_back()

    return run


def _shared_of_bucket(t: pa.Table) -> pa.Table:
    """(set, n): how many shingles of a bucket each set shares with another; what was counted before is added."""
    key, own = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    who, many = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for b in t.to_batches():
        sets, codes, counts = b.column("sets"), b.column("codes"), b.column("counts")
        for i in range(b.num_rows):
            name = sets[i].values.to_numpy()
            if codes[i].is_valid:
                raw = np.frombuffer(codes[i].as_buffer(), dtype=np.uint8)
                n = len(raw) // 9
                key.append(W.from_seven(raw[: 7 * n]))
                own.append(name[np.frombuffer(raw[7 * n :].tobytes(), dtype="<u2")])
            else:
                who.append(name)
                many.append(np.frombuffer(counts[i].as_buffer(), dtype="<u4").astype(np.int64))
    k, o = np.concatenate(key), np.concatenate(own)
    del key, own
    order = np.lexsort((o, k))
    k, o = k[order], o[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    k, o = k[new], o[new]
    twin = np.zeros(len(k), dtype=bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= k[1:] == k[:-1]
    o = o[twin & (o != NOBODY)]
    name, at = np.unique(np.concatenate([*who, o]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([*many, np.ones(len(o), dtype=np.int64)]), minlength=len(name)).astype(np.int64)
    W.give_back()
    return pa.table({"d1": pa.array(name, pa.int64()), "shared": pa.array(n, pa.int64())})


def _candidates(k: int, percent: int, shared):
    """Of each candidate: its text, squeezed, and the first shingles that lead to others."""
    import zstandard

    def run(batches):
        order = Order(shared.value)
        z = zstandard.ZstdCompressor(level=1)
        for b in W.chunks(batches, "text"):
            asked = b.column("d1").to_pylist()
            keep, raw, heads, size = [], [], [], []
            for i, (_, s) in enumerate(shingle_sets(b.column("text"), k)):
                if len(s) and _digest(s)[0] == asked[i]:  # rows may repeat an id with other texts
                    keep.append(i)
                    raw.append(z.compress(b.column("text")[i].as_buffer()))
                    heads.append(order.of(s)[0][: prefix_size(len(s), percent)].view(np.int64))
                    size.append(len(s))
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d1"), pa.array(size, pa.int64()), pa.array(raw, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], names=["doc_id", "d1", "n", "z", "heads"])
        W.give_back()

    return run


#: Nodes over so many leaves are the trunk, which is judged first.
TRUNK = 32


class Trie:
    """Sorted token arrays as a path-compressed trie. Nodes are numbered parents first, each before its subtree;
    a node's tokens are its part of the path. ``leaf[i]`` is the node where set i ends."""

    def __init__(self, sets: list[np.ndarray], tokens: int):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        end, parent, rep, leaf = [0], [-1], [-1], [0] * len(sets)
        stack, before = [0], None
        for i in self.order:
            same = 0
            if before is not None:
                a, b = sets[before], sets[i]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                same = int(differ[0]) if len(differ) else m
            below = -1
            while end[stack[-1]] > same:
                below = stack.pop()
            if end[stack[-1]] < same:
                end.append(same), parent.append(stack[-1]), rep.append(before)
                parent[below] = len(end) - 1
                stack.append(len(end) - 1)
            if len(sets[i]) > end[stack[-1]]:
                end.append(len(sets[i])), parent.append(stack[-1]), rep.append(i)
                stack.append(len(end) - 1)
            leaf[i], before = stack[-1], i
        children: list[list[int]] = [[] for _ in end]
        for v, p in enumerate(parent):
            if p >= 0:
                children[p].append(v)
        number, todo = [], [0]
        while todo:
            v = todo.pop()
            number.append(v)
            todo += children[v]
        at = np.empty(len(end), dtype=np.int64)
        at[number] = np.arange(len(number))
        self.end = np.array(end)[number]
        self.parent = np.where(np.array(parent)[number] >= 0, at[np.array(parent)[number]], -1)
        self.leaf = at[leaf]
        lens = np.array([len(s) for s in sets])
        self.least, self.most = np.full(len(end), np.iinfo(np.int64).max), np.zeros(len(end), dtype=np.int64)
        np.minimum.at(self.least, self.leaf, lens)
        np.maximum.at(self.most, self.leaf, lens)
        self.after = np.arange(1, len(end) + 1)  # the first node behind the subtree
        many = np.bincount(self.leaf, minlength=len(end))
        for v in range(len(end) - 1, 0, -1):
            p = self.parent[v]
            self.least[p], self.most[p] = min(self.least[p], self.least[v]), max(self.most[p], self.most[v])
            self.after[p] = max(self.after[p], self.after[v])
            many[p] += many[v]
        self.trunk = np.flatnonzero(many > TRUNK)
        reps = np.array(rep)[number].tolist()
        starts = np.where(self.parent >= 0, self.end[self.parent], 0)
        parts = [sets[r][s:e] if r >= 0 else sets[0][:0] for r, s, e in zip(reps, starts.tolist(), self.end.tolist(), strict=True)]
        self.last = np.array([int(p[-1]) if len(p) else -1 for p in parts])
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        node = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        in_trunk = np.zeros(len(end), dtype=bool)
        in_trunk[self.trunk] = True
        self.posts = [self._posts(flat[in_trunk[node] == t], node[in_trunk[node] == t], tokens) for t in (True, False)]

    @staticmethod
    def _posts(flat: np.ndarray, node: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes by token, and where those of each token begin."""
        order = np.argsort(flat, kind="stable")
        return node[order], np.searchsorted(flat[order], np.arange(tokens + 1))

    def hits(self, mine: np.ndarray, which: int) -> np.ndarray:
        """How many of my tokens each node has, in the trunk (0) or outside (1)."""
        node, first = self.posts[which]
        return np.bincount(node[_ranges(first[mine], first[mine + 1])], minlength=len(self.end))

    def along_paths(self, hits: np.ndarray) -> np.ndarray:
        """Sums from the root down to each node."""
        return np.cumsum(hits - np.bincount(self.after, weights=hits, minlength=len(hits) + 1)[: len(hits)])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def trie_links(sets: list[np.ndarray], percent: int = 75, order: Order | None = None, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of all pairs of sorted sets with similarity of ``percent`` or more.

    Sets of one label are known to be joined; where sides are given, only sets of different sides are compared."""
    n = len(sets)
    lens = np.array([len(s) for s in sets], dtype=np.int64)
    grams, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    hot = order.is_frequent(grams) if order and len(order.frequent) else np.zeros(len(grams), dtype=bool)
    rank = np.empty(len(grams), dtype=np.int64)
    rank[np.concatenate([np.flatnonzero(~hot), np.flatnonzero(hot)])[::-1]] = np.arange(len(grams))
    flat, ends = rank[inverse], np.concatenate([[0], np.cumsum(lens)])
    local = [np.sort(flat[ends[i] : ends[i + 1]]).astype(np.uint32) for i in range(n)]
    trie = Trie(local, len(grams))
    label = np.unique(np.arange(n) if labels is None else labels, return_inverse=True)[1]
    members: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        members.setdefault(x, []).append(i)
    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        a, b = int(label[i]), int(label[j])
        if a == b:
            return
        if len(members[a]) < len(members[b]):
            a, b = b, a
        moved = members.pop(b)
        label[moved] = a
        members[a] += moved
        links.append((i, j))

    # A link needs a common shingle among the first of both in the global order: the ends of the paths.
    heads = [m[len(m) - prefix_size(len(m), percent) :].astype(np.int64) for m in local]
    head = np.concatenate(heads)
    by = np.argsort(head, kind="stable")
    holder = np.repeat(np.arange(n), [len(h) for h in heads])[by]
    first = np.searchsorted(head[by], np.arange(len(grams) + 1))
    place = np.empty(n, dtype=np.int64)
    place[trie.order] = np.arange(n)

    def fits(overlap, total):
        return (100 + percent) * overlap >= percent * total  # 100 * |A & B| >= percent * |A | B|

    t = trie.trunk
    for x in trie.order:
        if len(members) == 1:
            break
        mine, size = local[x].astype(np.int64), int(lens[x])
        near = np.zeros(n, dtype=bool)
        near[holder[_ranges(first[heads[x]], first[heads[x] + 1])]] = True
        near &= (label != label[x]) & (place > place[x]) & (100 * np.minimum(lens, size) >= percent * np.maximum(lens, size))
        if sides is not None:
            near &= sides != sides[x]
        able = np.flatnonzero(near)
        if not len(able):
            continue
        if len(able) <= 4:
            for j in able.tolist():
                if fits(np.isin(local[j], mine, assume_unique=True).sum(), size + int(lens[j])):
                    link(x, j)
            continue
        trunk = trie.hits(mine, 0)
        if len(t):
            overlap, depth = trie.along_paths(trunk)[t], trie.end[t]
            rest = size - np.searchsorted(mine, trie.last[t], side="right")
            best = np.clip(depth + rest, trie.least[t], trie.most[t])
            dead = ~fits(overlap + np.minimum(rest, best - depth), size + best)
            gone = np.bincount(t[dead], minlength=len(trie.end) + 1) - np.bincount(trie.after[t[dead]], minlength=len(trie.end) + 1)
            able = able[np.cumsum(gone)[trie.leaf[able]] == 0]
            if not len(able):
                continue
        got = trie.along_paths(trunk + trie.hits(mine, 1))[trie.leaf[able]]
        for j in able[fits(got, size + lens[able])].tolist():
            link(x, j)
    return links


def _join_group(k: int, percent: int, shared):
    """Links between the texts of one group."""

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        d = zstandard.ZstdDecompressor()
        order = np.lexsort((t.column("d1").to_numpy(), t.column("doc_id").to_numpy()))
        ids, label, side = (t.column(c).to_numpy()[order] for c in ("doc_id", "label", "side"))
        raw = t.column("z").combine_chunks()
        sets: list[np.ndarray] = []
        for lo in range(0, len(order), 256):
            texts = [d.decompress(raw[i].as_buffer()) for i in order[lo : lo + 256].tolist()]
            sets += [s for _, s in shingle_sets(pa.array(texts, pa.large_binary()).cast(pa.large_string()), k)]
        links = trie_links(sets, percent, Order(shared.value), label, side if side.any() else None)
        out = np.array(links, dtype=np.int64).reshape(-1, 2)
        found = pa.table({"u": pa.array(ids[out[:, 0]]), "v": pa.array(ids[out[:, 1]])})
        del sets
        W.give_back()
        return found

    return run


def _bins(volume: DataFrame, key: str, limit: int) -> DataFrame:
    """``volume`` (key, vol, ...) with ``parts``, into how many a key is cut, and ``bin``, where small keys meet (null for a large one)."""
    small = F.col("vol") <= limit // 4
    total = volume.where(small).agg(F.sum("vol")).first()[0] or 0
    many = max(1, -(-4 * total // limit))
    bin_ = F.when(small, F.pmod(F.xxhash64(key), F.lit(many)))
    return volume.withColumn("bin", bin_).withColumn("parts", F.when(small, F.lit(1)).otherwise(F.ceil(F.col("vol") / limit)).cast("int"))


def _pivot_groups(able: DataFrame, heads: DataFrame, limit: int) -> DataFrame:
    """(group, doc_id, side, label): each set with its pivot; a pivot is in each part of its group."""
    least = heads.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram", "low")
    pairs = heads.join(least, "gram").where("doc_id <> low").groupBy("doc_id", "n", "low").agg(F.count("*").alias("common"))
    pivots = staged(pairs.groupBy("doc_id", "n").agg(F.max_by("low", F.struct("common", -F.col("low"))).alias("low")), "pivots")
    plan = _bins(pivots.groupBy("low").agg(F.sum("n").alias("vol")), "low", limit)
    part = F.when(F.col("bin").isNotNull(), F.concat(F.lit("s"), F.col("bin").cast("string"))).otherwise(F.concat_ws(":", "low", "part"))
    members = pivots.join(plan, "low").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("long")).cast("int")).select(part.alias("group"), "doc_id")
    centres = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(part.alias("group"), F.col("low").alias("doc_id"))
    return members.unionByName(centres).distinct().select("group", "doc_id", F.lit(0).alias("side"), F.col("doc_id").alias("label"))


def _late_groups(heads: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(group, doc_id, side, label) of the sets that hold a shingle whose holders have two labels or more.

    The least label of a shingle's holders names where they meet, so two sets of different labels that share a shingle meet at least once."""
    h = heads.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    live = h.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("gram", "low")
    sets = staged(h.join(live, "gram").select("low", "doc_id", "n", "label").distinct(), "live")
    by_label = sets.groupBy("low", "label").agg(F.sum("n").alias("vol"))
    where = _bins(by_label.groupBy("low").agg(F.sum("vol").alias("vol")), "low", limit)
    where = staged(where.select("low", "parts", F.coalesce(F.concat(F.lit("s"), F.col("bin").cast("string")), F.concat(F.lit("l"), F.col("low").cast("string"))).alias("group")), "where")
    one = sets.join(where.where("parts = 1").select("low", "group"), "low").select("group", "doc_id", F.lit(0).alias("side"), "label").distinct()
    # Where a task cannot hold all: a label that is large by itself has its own parts, other labels share some; no pair of parts holds one label only.
    large = by_label.join(where.where("parts > 1").select("low", "parts"), "low").withColumnRenamed("parts", "shared")
    large = large.withColumn("own", F.when(F.col("vol") > limit // 4, F.ceil(F.col("vol") / (limit // 2))).cast("int"))
    tag = F.when(F.col("own").isNotNull(), F.concat_ws(":", "label", F.pmod(F.xxhash64("doc_id"), F.col("own").cast("long")))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), 2 * F.col("shared").cast("long"))))
    cut = sets.join(large.select("low", "label", "own", "shared"), ["low", "label"]).select("low", tag.alias("part"), F.when(F.col("own").isNotNull(), F.col("label")).alias("only"), "doc_id", "label")
    cut = staged(cut, "parts")
    if cut.isEmpty():
        return one
    parts = cut.select("low", "part", "only").distinct()
    a, b = parts.select("low", F.col("part").alias("a"), F.col("only").alias("only_a")), parts.select("low", F.col("part").alias("b"), F.col("only").alias("only_b"))
    pairs = a.join(b, "low").where("a <= b and (only_a is null or not only_a <=> only_b)").select("low", "a", "b")
    group = F.concat_ws("|", "low", "a", "b").alias("group")
    left = pairs.join(cut.withColumnRenamed("part", "a"), ["low", "a"]).select(group, "doc_id", F.lit(0).alias("side"), "label")
    right = pairs.where("a < b").join(cut.withColumnRenamed("part", "b"), ["low", "b"]).select(group, "doc_id", F.lit(1).alias("side"), "label")
    return one.unionByName(left).unionByName(right)


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 75, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) of every row of ``docs`` (doc_id, text, ...).

    Null, empty and blank texts have an empty set, n_shingles 0, and are linked with
    nothing. Fewer than ``k`` words are one shingle. Rows with equal sets, repeated rows
    too, share set_id (the smallest such doc_id); rows with a null doc_id are left out, as they
    cannot be named. Rows that repeat a doc_id with different texts link it by each of them. Extra columns are ignored. An empty table gives an empty table.

    Results of the steps are written to the shared folder. Broadcast are the frequent shingles (MAX_FREQUENT at most) and
    up to BROADCAST_IDS ids of candidates."""
    spark = docs.sparkSession
    prepare(spark)
    docs = plain(docs, "doc_id", "text").where("doc_id is not null")
    profile = staged(docs.mapInArrow(_profile(k), "kind byte, id long, n long, d1 long, d2 long"), "profile")
    sizes = profile.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "d1", "d2")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    frequent = profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(max(16, total // MAX_FREQUENT))).select("id")
    listed = np.sort(np.array([r[0] for r in frequent.toLocalIterator()], dtype=np.int64).view(np.uint64))  # MAX_FREQUENT at most
    shared = spark.sparkContext.broadcast(listed)

    bits = max(8, (total // BUCKET).bit_length())
    found = docs.mapInArrow(_by_bucket(k, percent, bits, shared), "bucket long, sets array<long>, codes binary, counts binary")
    found = found.groupBy("bucket").applyInArrow(_shared_of_bucket, "d1 long, shared long").groupBy("d1").agg(F.sum("shared").alias("shared"))
    sets = staged(sizes.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("set_id")), "sets")
    asked = sets.join(found, "d1").where(F.col("shared") >= needed(F.col("n_shingles"), percent)).select(F.col("set_id").alias("doc_id"), "d1")
    asked = staged(asked, "asked")
    many = asked.count()
    chosen = docs.join(F.broadcast(asked) if many <= BROADCAST_IDS else asked, "doc_id").select("doc_id", "text", "d1")
    able = staged(chosen.mapInArrow(_candidates(k, percent, shared), "doc_id long, d1 long, n long, z binary, heads array<long>"), "candidates")
    if able.count() > many:  # repeated rows
        able = staged(able.dropDuplicates(["doc_id", "d1"]), "candidates")

    heads = able.select("doc_id", "n", F.explode("heads").alias("gram"))

    def join(groups: DataFrame) -> DataFrame:
        """The links of each group, written before they go on, so that a task that joins has one Python worker."""
        held = groups.join(able.select("doc_id", "d1", "z"), "doc_id")
        return staged(held.groupBy("group").applyInArrow(_join_group(k, percent, shared), "u long, v long"), "links")

    known = connected_components(join(_pivot_groups(able, heads, limit))).select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    known = staged(known, "labels")
    late = join(_late_groups(heads, known, limit))
    parts = connected_components(known.select(F.col("doc_id").alias("u"), F.col("label").alias("v")).unionByName(late))
    parts = parts.select(F.col("node").alias("set_id"), "component")
    return (
        sizes.join(sets, ["n_shingles", "d1", "d2"], "left")
        .join(parts, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("set_id", "doc_id").alias("set_id"),
            F.coalesce("component", "set_id", "doc_id").alias("component_id"),
        )
    )


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without all but the first document (smallest doc_id) of each component.

    Of rows that repeat a doc_id one stays: the least by text, then by the other columns' hash; rows whose doc_id is null stay."""
    found = staged(similar_documents(docs, k, percent), "near")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(few(gone, BROADCAST_IDS), "doc_id", "left_anti")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    least = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    place = free_name(docs, "place")
    one = kept.join(twice, "doc_id", "left_semi").withColumn(place, F.row_number().over(least)).where(F.col(place) == 1)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))
