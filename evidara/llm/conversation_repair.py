"""Conversation structure repair: the cheapest edits that give roles of the form ``(s?(ua)+)?``.

A conversation is a sequence of symbols (role and fault of a row). Each symbol has a min-plus transition
over the four states of the role pattern; equal neighbours are one run, and a run of n rows is n's bits in
cached binary powers of its transition. Costs to go from every row on give the choices, first in ASCII order.

The rows of all conversations are ordered by ranges, so a conversation of any length lies in slices of many tasks,
and is cut into pieces of at most PIECE_ROWS rows. Pieces that hold a whole conversation are solved alone. The
pieces of a longer one give a matrix each; a fold over these matrices (16 numbers a piece) gives the cost to go
after each piece, and a second one over exit states gives each piece's first state, whereupon the pieces are
unrolled apart. Only the digest of a repaired text, one SHA-256 over all of it, is read in order by one task, as a
stream of pieces."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.session import plain, prepare, table
from evidara.llm.words import give_back
from evidara.plans.storage import staged

#: A piece ends at so many rows or bytes of text.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20
#: Rows of a run whose costs to go are held at once.
BLOCK = 64
INF = 1 << 40
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. An inserted or re-roled row is the only one of user and assistant that fits.
FITS = {0: 2, 1: 2, 2: 3, 3: 2}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {2: "user", 3: "assistant"}
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Symbols: 0 has to go; 1 to 4 are roles s, u, a and others; 5 to 8 the same with a truncated text.
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}


def symbol(initial: str, fault: str) -> int:
    if fault in ("blank", "duplicate"):
        return 0
    return 1 + (INITIALS.index(initial) if initial and initial in INITIALS else 3) + 4 * (fault == "truncated")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of two matrices, or of a matrix and a vector."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), INF) if b.ndim == 2 else np.minimum((a + b[None, :]).min(axis=1), INF)


def _inserts() -> np.ndarray:
    """Costs of getting from state to state by inserts alone."""
    out = np.full((4, 4), INF, dtype=np.int64)
    for q in range(4):
        at, cost = q, 0
        for _ in range(4):
            out[q, at] = min(out[q, at], cost)
            at, cost = FITS[at], cost + INSERT
    return out


INSERTS = _inserts()
#: Costs to go after the last row: inserts until the pattern is whole.
LAST = np.array([len(TAIL[q]) * INSERT for q in range(4)], dtype=np.int64)


def choices(sym: int, q: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that take the row, in ASCII order."""
    out = [("D", DELETE, q)]
    if sym:
        extra = TRUNCATED if sym > 4 else 0
        initial = (INITIALS + "?")[(sym - 1) % 4]
        if (q, initial) in KEEPS:
            out.append(("K", extra, KEEPS[q, initial]))
        out.append(("R", REROLE + extra, FITS[q]))
    return out


@functools.cache
def power(sym: int, k: int) -> np.ndarray:
    """The transition of 2**k rows of a symbol, inserts before each row included."""
    if k:
        half = power(sym, k - 1)
        return times(half, half)
    step = np.full((4, 4), INF, dtype=np.int64)
    for q in range(4):
        for _, cost, to in choices(sym, q):
            step[q, to] = min(step[q, to], cost)
    return times(INSERTS, step)


def before(sym: int, n: int, costs: np.ndarray) -> np.ndarray:
    """Costs to go before a run of n rows (or its matrix), from those after it."""
    k = 0
    while n:
        if n & 1:
            costs = times(power(sym, k), costs)
        n, k = n >> 1, k + 1
    return costs


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of each run of equal neighbours."""
    x = np.frombuffer(symbols, dtype=np.uint8)
    if not len(x):
        return []
    cut = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
    return [(int(x[lo]), int(hi - lo)) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def matrix(symbols: bytes) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, INF).astype(np.int64)
    for sym, n in reversed(runs(symbols)):
        out = before(sym, n, out)
    return out


def unroll(symbols: bytes, q: int, after: np.ndarray) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of these rows from state ``q`` on, given the costs to go after them; and the state then.

    Two cheapest audits never lie one inside the other, so the least choice at each step gives the least audit."""
    every = runs(symbols)
    ends = [after]
    for sym, n in reversed(every[1:]):
        ends.append(before(sym, n, ends[-1]))
    audit: list[str] = []
    for (sym, n), end in zip(every, reversed(ends), strict=False):
        options, step = [choices(sym, s) for s in range(4)], power(sym, 0)
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            to_go = [before(sym, n - hi, end)]
            for _ in range(hi - lo):
                to_go.append(times(step, to_go[-1]))
            for j in range(hi - lo, 0, -1):
                here, there = to_go[j], to_go[j - 1]
                while True:
                    best = here[q]
                    found = {e: to for e, cost, to in options[q] if cost + there[to] == best}
                    if "D" not in found and INSERT + here[FITS[q]] == best:
                        audit.append("I")
                        q = FITS[q]
                        continue
                    edit = min(found)
                    audit.append(edit)
                    q = found[edit]
                    break
    return "".join(audit), q


@functools.lru_cache(maxsize=1 << 14)
def solved(symbols: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    audit, q = unroll(symbols, 0, LAST)
    return int(times(matrix(symbols), LAST)[0]), audit + TAIL[q]


def repaired(audit: str, q: int, roles: Iterable[str], texts: Iterable[str], counts: Iterable[int]) -> Iterator[str]:
    """Lines ``role:text`` after the edits, from state ``q`` on."""
    rows = ((r, t) for r, t, n in zip(roles, texts, counts, strict=True) for t in [t] * n)
    for edit in audit:
        if edit == "I":
            q = FITS[q]
            yield f"{ROLE[q]}:"
            continue
        role, text = next(rows)
        if edit == "K":
            q = KEEPS[q, role[:1]]
            yield f"{role}:{text}"
        elif edit == "R":
            q = FITS[q]
            yield f"{ROLE[q]}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id as text, turn, role, text, n): distinct rows after the damage, with how often each occurs there."""
    d = plain(conversations, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("string"))
    kind = F.crc32(F.concat(F.coalesce("conv_id", F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    d = d.withColumn("kind", kind).where("kind <> 0")
    d = d.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    d = d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return d.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def faulty(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``: the first of blank, duplicate, truncated, or an empty string.

    A text is a duplicate if its conversation has it with the same role at an earlier turn; where a row occurs n times, its copies are."""
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keyed = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    often = keyed.groupBy("conv_id", "role", "key").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1")
    often = often.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("first").isNotNull() & (F.col("first") < at), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return keyed.join(often, same, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


PIECES = "piece long, conv_id string, whole boolean, symbols binary, initials string, roles array<string>, texts array<string>, counts array<long>, turns array<long>, blank long, duplicate long, truncated long"


def _pieces(batches, schema: pa.Schema):
    """Ordered rows to pieces; ``whole`` where a conversation surely begins and ends in this slice."""
    slice_ = TaskContext.get().partitionId() << 32
    no, held, size, first, fresh = 0, [], 0, True, True

    def close(ends: bool):
        nonlocal no, held, size
        symbols, initials, count = bytearray(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text, n, fault in held:
            again = fault if fault == "blank" else "duplicate"
            symbols += bytes([symbol(role[:1], fault)]) + bytes(n - 1)
            initials.append((role[:1] or " ") * n)
            for f, k in ((fault, 1), (again, n - 1)):
                if f:
                    count[f] += k
        turns = sorted({x[1] for x in held if x[1] is not None})
        row = (slice_ + no, held[0][0], whole and ends, bytes(symbols), "".join(initials), [x[2] for x in held], [x[3] for x in held], [x[4] for x in held], [turns[0], turns[-1], len(turns)] if turns else [], *count.values())
        no, held, size = no + 1, [], 0
        return row

    whole, out = False, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if fresh or row[0] != now:
                if held:
                    out.append(close(True))
                whole, now, first, fresh = not first, row[0], False, False
            elif len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                out.append(close(False))
                whole = False
            held.append(row)
            size += len(row[3])
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
                out = []
    if held:
        out.append(close(False))  # the conversation may go on in the next slice
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
    give_back()


def pieces(rows: DataFrame) -> DataFrame:
    """All conversations as pieces, staged; ``piece`` grows with the order of the rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], PIECES).schema)
    d = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return staged(d.mapInArrow(lambda batches: _pieces(batches, schema), PIECES), "pieces")


def illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _alone(frames):
    """Results of pieces that are whole conversations."""
    for p in frames:
        out = []
        for r in p.itertuples(index=False):
            cost, audit = solved(bytes(r.symbols))
            text = "\n".join(repaired(audit, 0, r.roles, r.texts, r.counts))
            gaps = int(r.turns[1] - r.turns[0] + 1 - r.turns[2]) if len(r.turns) else 0
            out.append((r.conv_id, gaps, r.blank, r.duplicate, r.truncated, illegal(r.initials), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
        yield pd.DataFrame(out, columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _outlines(frames):
    for p in frames:
        yield pd.DataFrame({"piece": p["piece"], "conv_id": p["conv_id"], "steps": [matrix(bytes(x)).ravel().tolist() for x in p["symbols"]], "illegal": [illegal(x) for x in p["initials"]],
                            "first": [x[:1] for x in p["initials"]], "last": [x[-1:] for x in p["initials"]], "turns": p["turns"], "blank": p["blank"], "duplicate": p["duplicate"], "truncated": p["truncated"]})


def _backward(p: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a conversation: the costs to go after each, and on the first one the sums of all."""
    p = p.sort_values("piece", ignore_index=True)
    after, costs = [None] * len(p), LAST
    for i in range(len(p) - 1, -1, -1):
        after[i] = costs.tolist()
        costs = times(np.array(p["steps"][i], dtype=np.int64).reshape(4, 4), costs)
    bad = int(p["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(p["last"][:-1], p["first"][1:], strict=True))
    turns = [t for t in p["turns"] if len(t)]
    gaps = int(turns[-1][1] - turns[0][0] + 1 - sum(t[2] for t in turns) + sum(a[1] == b[0] for a, b in zip(turns, turns[1:], strict=False))) if turns else 0
    out = p[["piece", "conv_id"]].assign(after=after, gaps=0, illegal=0, cost=0, blank=p["blank"], duplicate=p["duplicate"], truncated=p["truncated"])
    out.loc[0, ["gaps", "illegal", "cost"]] = gaps, bad, int(costs[0])
    return out


def _forward(p: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece begins, and whether it is the last."""
    p = p.sort_values("piece", ignore_index=True)
    q, begins = 0, []
    for exits in p["exits"]:
        begins.append(q)
        q = int(exits[q])
    return p[["piece"]].assign(state=begins, ends=[*[False] * (len(p) - 1), True])


def _exits(frames):
    for p in frames:
        yield pd.DataFrame({"piece": p["piece"], "conv_id": p["conv_id"], "exits": [[unroll(bytes(s), q, np.array(a, dtype=np.int64))[1] for q in range(4)] for s, a in zip(p["symbols"], p["after"], strict=True)]})


def _lines(frames):
    """Audit and repaired lines of each piece."""
    for p in frames:
        audits, parts = [], []
        for r in p.itertuples(index=False):
            audit, q = unroll(bytes(r.symbols), r.state, np.array(r.after, dtype=np.int64))
            audit += TAIL[q] if r.ends else ""
            audits.append(audit)
            parts.append("".join(x + "\n" for x in repaired(audit, r.state, r.roles, r.texts, r.counts)))
        yield pd.DataFrame({"piece": p["piece"], "conv_id": p["conv_id"], "audit": audits, "lines": parts})


def _digests(frames):
    """Ordered pieces to one digest for each conversation; a piece at a time is held, and the audit."""
    now, seen, audit, sha, pending = None, False, [], hashlib.sha256(), b""

    def row():
        return pd.DataFrame({"conv_id": [now], "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()]})

    for p in frames:
        for r in p.itertuples(index=False):
            same = seen and (r.conv_id == now or pd.isna(r.conv_id) and pd.isna(now))
            if not same:
                if seen:
                    yield row()
                now, seen, audit, sha, pending = r.conv_id, True, [], hashlib.sha256(), b""
            audit.append(r.audit)
            if r.lines:  # the last line's end is no part of the text
                raw = r.lines.encode()
                sha.update(pending + raw[:-1])
                pending = raw[-1:]
    if seen:
        yield row()


def _in_parts(part: DataFrame) -> DataFrame:
    """Results of the conversations that lie in several pieces, or may."""
    outlines = part.mapInPandas(_outlines, "piece long, conv_id string, steps array<long>, illegal long, first string, last string, turns array<long>, blank long, duplicate long, truncated long")
    sums = staged(outlines.groupBy("conv_id").applyInPandas(_backward, "piece long, conv_id string, after array<long>, gaps long, illegal long, cost long, blank long, duplicate long, truncated long"), "costs_to_go")
    known = part.select("piece", "conv_id", "symbols", "roles", "texts", "counts").join(sums.select("piece", "after"), "piece")
    states = known.select("piece", "conv_id", "symbols", "after").mapInPandas(_exits, "piece long, conv_id string, exits array<int>").groupBy("conv_id").applyInPandas(_forward, "piece long, state int, ends boolean")
    lines = known.join(states, "piece").mapInPandas(_lines, "piece long, conv_id string, audit string, lines string")
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    digests = ordered.mapInPandas(_digests, "conv_id string, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    total = sums.groupBy("conv_id").agg(*[F.sum(x).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
    return total.join(digests, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def repair(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Nulls in conv_id, turn, role and text count as one space, but a null turn stays null in the order (first) and
    for gaps; null conv_ids are one conversation. Rows of one turn are ordered by role and text; rows that repeat in all four columns are copies of
    which the first stays. An empty table gives an empty table; very long texts and conversations of any number of rows are read whole; other columns are ignored.
    A role's initial is its first character as it is written; any but s, u and a fits nowhere."""
    spark = conversations.sparkSession
    prepare(spark)
    all_pieces = pieces(faulty(damaged(conversations)))
    alone = all_pieces.where("whole").mapInPandas(_alone, RESULT)
    found = alone.unionByName(_in_parts(all_pieces.where("not whole")))
    found = found.withColumnRenamed("conv_id", "c").withColumn("some", F.lit(True))
    ids = plain(conversations, "conv_id").distinct()
    d = ids.join(found, F.col("conv_id").cast("string").eqNullSafe(F.col("c")), "left").drop("c")
    number = {x: F.coalesce(x, F.lit(0).cast("long")) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return d.withColumns({**number, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}).drop("some")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
