"""Conversation repair against a plain search over edits, and on odd rows."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from evidara.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """(cost, audit, lines) of the best edits by trying all: rows are (role, text, fault)."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserted):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            c, a, x = best(i + 1, last, 0)
            found.append((c + 3, "D" + a, x))
            if fault not in ("blank", "duplicate"):
                extra = 1 if fault == "truncated" else 0
                if role[:1] and role[:1] in step[last]:
                    c, a, x = best(i + 1, role[:1], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}", *x)))
                for new in ("user", "assistant"):
                    if new[0] in step[last]:
                        c, a, x = best(i + 1, new[0], 0)
                        found.append((c + extra + 2, "R" + a, (f"{new}:{text}", *x)))
        if inserted < 4:
            for new in ("user", "assistant"):
                if new[0] in step[last]:
                    c, a, x = best(i, new[0], inserted + 1)
                    found.append((c + 2, "I" + a, (f"{new}:", *x)))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 0)


def plain(rows):
    """{conv_id: results} of rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            role = "user" if k == 4 else role
            after += [(turn, role, text)] * (2 if k == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in after:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in after if r[0] is not None}
        cost, audit, lines = cheapest(tuple((r[1], r[2], f) for r, f in zip(after, faults, strict=True)))
        bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def some(seed=1, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.choice((1, 2, 5, 9, 14))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "User"))
            rows.append((c, t + rng.choice((0, 0, 3)), role, rng.choice(("Yes.", "No!", "cut off", "", " \t", f"text {t}?", "ends here. \n", "naïve ß\xa0"))))
    return rows


ODD = [(None, 1, "user", "one."), (None, None, None, "two."), (None, 2, "assistant", None), (900, None, "user", "a."), (900, None, "user", "a."), (900, None, "user", "b"), (900, 5, "user", "a."),
       (901, 1, "system", "only."), (902, 3, "assistant", "x" * 300_000 + "."), (902, 4, "user", "y" * 70), (902, 4, "user", "y" * 69 + "z.")]


def test_against_all_edits(spark):
    rows = some() + ODD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as piece", "'x' as fault", "2 as n", "'k' as whole").repartition(3)
    out = C.repair(df)
    assert out.count() == len({r[0] for r in rows})
    assert results(out) == plain(rows)


@pytest.mark.parametrize(("size", "slices"), [(1, 3), (3, 40), (4096, 7)])
def test_conversations_over_many_pieces(spark, monkeypatch, size, slices):
    rng = random.Random(size)
    rows = [(c, t, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("Yes.", "cut", f"t {t}.", f"u {t}?"))) for c, n in ((1, 90), (2, 3), (3, 40), (4, 1)) for t in range(n)]
    rows += [(5, 7, "user", "again.")] * 30 + [(6, None, "assistant", f"z{i}.") for i in range(25)]
    d = C.faulty(C.damaged(spark.createDataFrame(rows, SCHEMA)))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    monkeypatch.setattr(C, "PIECE_ROWS", size)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        assert C.pieces(d).where("not whole").count() > 1
        assert results(C.repair(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_binary_powers_of_a_long_run():
    for sym in range(9):
        for n in (1, 2, 7, 64, 65, 300):
            by_row = C.LAST
            for _ in range(n):
                by_row = C.times(C.power(sym, 0), by_row)
            assert (C.before(sym, n, C.LAST) == by_row).all()
            cost, audit = C.solved(bytes([sym]) * n)
            assert cost == by_row[0] and len(audit) - audit.count("I") == n
    assert PATTERN.fullmatch("") and C.solved(b"") == (0, "")
    assert C.solved(bytes([2]) * 100_000)[0] > 0


def test_no_rows(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    assert results(C.repair(spark.createDataFrame([(3, dropped, "user", "gone.")], SCHEMA))) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
