"""Full case folding as expressions of two engines, from one table that Unicode's rule gives.

Spark has no folding of its own, and its ``lower`` follows another version of Unicode and looks at neighbours (a final sigma). So only ASCII
texts are lowered. In others, code points with one other form are translated by a map in the JVM, and those that fold to several (ŉ, ﬁ, ΐ ...) are looked
up one by one, in texts that have any; ß, the frequent one, is replaced. Texts within Latin-1 but for the micro sign are lowered too, where the two are
the same but for ß. The DuckDB form translates and replaces by the same table."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts of Latin-1 characters without the micro sign, the only one of them that folds to a character beyond.
LATIN = r"^[\x00-\xb4\xb6-\xff]*+$"


@functools.cache
def foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Code points that fold to one other, and those that fold to several."""
    changed = {x: f for x in map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))) if (f := x.casefold()) != x}
    return {x: f for x, f in changed.items() if len(f) == 1}, {x: f for x, f in changed.items() if len(f) > 1}


@functools.cache
def _parts() -> tuple[str, str, dict[str, str], str]:
    """From and to of the translation, the longer foldings but ß, and a class of the characters that need those."""
    one, many = foldings()
    rest = {x: f for x, f in many.items() if x != "ß"}
    need = sorted(map(ord, rest))
    runs: list[list[int]] = []
    for c in need:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(one), "".join(one.values()), rest, "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def folded(text: Column) -> Column:
    """``text`` as Python's ``str.casefold`` gives it."""
    source, target, rest, needs = _parts()
    low = F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), source, target)
    table = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*map(F.lit, rest.values())))
    by_one = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).when(F.rlike(text, F.lit(LATIN)), F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))).when(F.rlike(text, F.lit(needs)), by_one).otherwise(low)


def spark_sql(x: str) -> str:
    """``folded`` as Spark SQL."""
    source, target, rest, needs = _parts()
    low = f"translate(replace({x}, 'ß', 'ss'), '{source}', '{target}')"
    items = lambda values: ", ".join(f"'{v}'" for v in values)
    by_one = f"array_join(transform(split({low}, ''), c -> coalesce(element_at(map_from_arrays(array({items(rest)}), array({items(rest.values())})), c), c)), '')"
    return f"CASE WHEN octet_length({x}) = char_length({x}) THEN lower({x}) WHEN {x} RLIKE r'{LATIN}' THEN replace(lower({x}), 'ß', 'ss') WHEN {x} RLIKE '{needs}' THEN {by_one} ELSE {low} END"


def duck_sql(x: str) -> str:
    """The same for DuckDB."""
    one, many = foldings()
    out = f"translate({x}, '{''.join(one)}', '{''.join(one.values())}')"
    for a, b in many.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out
