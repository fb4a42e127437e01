"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); lines that fail are removed, and
a document is rejected when a base rule fails or too many of its words were in removed lines.

What few texts have (phrases, marks) is looked for once in the whole text; lines are asked for it where the text has it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm import words as W
from evidara.llm.session import table

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
#: Phrases that mark a whole line as boilerplate, looked for in lower case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "use of cookies",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "share on facebook",
    "click here to",
    "lorem ipsum",
    "cookie policy",
    "this site uses cookies",
    "sign up for our",
    "follow us on",
    "log in to your account",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "allgemeine geschäftsbedingungen",
    "diese website verwendet cookies",
    "cookies akzeptieren",
    "newsletter abonnieren",
    "folgen sie uns auf",
    "zum inhalt springen",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "conditions d'utilisation",
    "ce site utilise des cookies",
    "accepter les cookies",
    "inscrivez-vous à notre",
    "suivez-nous sur",
    "aller au contenu",
    "todos los derechos reservados",
    "política de privacidad",
    "aviso legal",
    "términos de uso",
    "este sitio utiliza cookies",
    "aceptar cookies",
    "suscríbete a nuestr",
    "síguenos en",
    "saltar al contenido",
)
#: Letters, about the rarest first. The phrases are looked for from the first one of these on that they have, as few places of a text begin so.
RARE = "jkqxzäáñíóéúàywvbpgfhcmd"


def _ends(phrases: tuple[str, ...]) -> str:
    """A pattern that every text with one of ``phrases`` matches, and few others: their ends, from a rare letter on."""
    ends = [p[min((p.index(c) for c in RARE if c in p[:-3]), key=lambda i: RARE.index(p[i]), default=0) :] for p in phrases]
    return f"[{''.join(sorted({e[0] for e in ends}))}](?:{'|'.join(sorted({e[1:] for e in ends}))})"


#: Marks that part the entries of a menu or a breadcrumb in one line.
SEPARATORS = "|›»>·•→"
#: So many lines or more one after another, of so few words each and without an end mark, are a menu with an entry a line.
MENU_LINES, MENU_WORDS = 5, 3
#: A longer line fails when it has two phrases or more and at most so many words for each.
WORDS_PER_PHRASE = 15
#: A line of this many words or fewer may be a heading, so it needs no end mark.
HEADING_WORDS = 12
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: More than this percentage of the words lost with removed lines rejects a document.
MAX_LOST_PERCENT = 50
#: Symbols of [#*$%&|<>] in a line, as a percentage of its words, at which its punctuation fails.
SYMBOL_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: What a line longer than a heading ends with, letters and digits included: only odd marks fail.
END_MARK = r"[.!?:;,\"'…»”’)\]\p{L}\p{N}]"
#: What ends an entry of no menu.
SENTENCE_END = r"[.!?:;,…]$"


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def _repeated(w: W.Words, k: int) -> np.ndarray:
    """Words of each text inside windows of ``k`` words whose sequence occurs twice or more in it, the first one included."""
    n, first, texts = len(w.start), w.first, len(w.first) - 1
    if n < k:
        return np.zeros(texts, dtype=np.int64)
    doc = np.repeat(np.arange(texts), np.diff(first))
    at = np.flatnonzero(doc[k - 1 :] == doc[: n - k + 1])  # windows of one text
    h = W.mix(W.rolling(w.hashes(), k)[at] + W.mix(doc[at].astype(np.uint64)))
    order = np.argsort(h)
    twin = h[order[1:]] == h[order[:-1]]
    hit = at[order[np.append(twin, False) | np.append(False, twin)]]
    step = np.bincount(hit, minlength=n + 1) - np.bincount(hit + k, minlength=n + 1)
    covered = np.append(0, np.cumsum(np.cumsum(step[:n]) > 0))
    return covered[first[1:]] - covered[first[:-1]]


def _counted(texts: pa.Array) -> np.ndarray:
    """Words of each text, the code points in them, and the words inside repeated windows: the figures of ``judged`` for an Arrow array."""
    w = W.layout(texts)
    chars = np.append(0, np.cumsum(~W.SEPARATOR[w.data] & (w.data & 0xC0 != 0x80)))[w.offsets]  # bytes that begin a code point
    return np.stack([np.diff(w.first), np.diff(chars), _repeated(w, WINDOW)], axis=1)


def window_hashes(hashes: Column, k: int) -> Column:
    """A 64-bit hash of every run of ``k`` entries: of two runs of half the length, and so on."""

    def joined(h: Column, step: int) -> Column:
        m = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(step + 1), m), lambda a, b: F.xxhash64(a, b))

    def grown(h: Column, span: int) -> Column:
        step = min(span, k - span)
        return let(h, lambda x: grown(joined(x, step), span + step)) if step else h

    return grown(hashes, 1)


def repeated_window_words(windows: Column, k: int = WINDOW) -> Column:
    """Words inside ``k``-word windows whose sequence occurs twice or more, the first one included, from the windows' hashes.

    Documents without a repeated hash, nearly all, end at a distinct count; for the others the
    positions are sorted by hash, so that the work stays n log n for the longest text."""

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            def twin(x, j):
                before = (j > 0) & (F.get(s, j - 1)["h"] == x["h"])
                after = F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                return before | after

            return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, flagged), union)

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows)).cast("long")


def counted(text: Column, which: str) -> Column:
    return F.length(text) - F.length(F.translate(text, which, ""))


def any_of(text: Column, which) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in which])


def phrases_in(text: Column, among: Column) -> Column:
    return let(F.lower(text), lambda low: F.filter(among, lambda p: low.contains(p)))


def seen(text: Column) -> Column:
    """What the lines of a text have to be asked for: its symbols, and whether it has separators, double exclamation marks and which phrases."""
    spaced = F.when(odd(text), F.regexp_replace(text, WS, " ")).otherwise(text)  # as the words of a phrase may lie further apart
    phrases = F.when(F.lower(spaced).rlike(_ends(BOILERPLATE)), phrases_in(spaced, F.array(*map(F.lit, BOILERPLATE))))
    symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    return F.struct(symbols.alias("symbols"), any_of(text, SEPARATORS).alias("bars"), text.contains("!!").alias("shouts"), phrases.alias("phrases"))


def odd(text: Column) -> Column:
    """Whether the pattern of white space would change more than put a space for a line's end or for a space."""
    return any_of(text, ("  ", "\t", "\x0b", "\f", "\r"))


def tidied(text: Column) -> Column:
    """(line, text, n) of every line: as it is, with single spaces for white space, and its words."""

    def tidy(odd: Column):
        n = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1
        of = lambda line, t: F.struct(line.alias("line"), t.alias("text"), F.when(t == "", 0).otherwise(n(t)).alias("n"))
        return lambda line: let(F.trim(F.when(odd, F.regexp_replace(line, WS, " ")).otherwise(line)), lambda t: of(line, t))

    return let(odd(text), lambda x: F.transform(F.split(text, "\n"), tidy(x)))


def line_rule(m: Column, in_menu: Column, seen: Column) -> Column:
    """Name of the first rule that a line (its tidy ``text`` and ``n`` words) fails, null if it passes; blank lines pass."""
    text, n = m["text"], m["n"]
    boiler = lambda k: ((k >= 1) & (n <= HEADING_WORDS)) | ((k >= 2) & (n <= WORDS_PER_PHRASE * k))
    shout = F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("!")))
    barred = let(counted(text, SEPARATORS), lambda bars: (bars >= 2) & (3 * bars >= n))
    return (
        F.when(text == "", F.lit(None))
        .when(in_menu | seen["bars"] & barred, "navigation")
        .when((seen["symbols"] > 0) & (100 * counted(text, SYMBOLS) >= SYMBOL_PERCENT * n), "punctuation")
        .when(seen["shouts"] & (n >= 3) & (2 * shout >= n), "punctuation")
        .when((n > HEADING_WORDS) & ~F.right(text, F.lit(1)).rlike(END_MARK), "punctuation")
        .when(seen["phrases"].isNotNull() & let(F.size(phrases_in(text, seen["phrases"])), boiler), "boilerplate")
        .cast("string")
    )


def line_verdicts(text: Column) -> Column:
    """(line, n, rule) of every line."""
    return let(F.struct(tidied(text).alias("lines"), seen(text).alias("seen")), lambda x: verdicts(x["lines"], x["seen"]))


def verdicts(lines: Column, seen: Column) -> Column:
    """(line, n, rule) of tidy ``lines``, of a text with what is ``seen`` in it."""
    entry = F.transform(lines, lambda m: (m["n"] > 0) & (m["n"] <= MENU_WORDS) & ~m["text"].rlike(SENTENCE_END))

    def runs(e: Column) -> Column:
        """For each place whether a run of MENU_LINES entries begins there."""
        begins = F.transform(e, lambda _, i: F.coalesce(F.get(e, i + (MENU_LINES - 1)), F.lit(False)) & F.forall(F.slice(e, i + 1, MENU_LINES), lambda y: y))
        return F.when(F.size(F.filter(e, lambda y: y)) >= MENU_LINES, begins)

    def rules(r: Column) -> Column:
        inside = lambda i: r.isNotNull() & F.exists(F.slice(r, F.greatest(i - (MENU_LINES - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(MENU_LINES))), lambda y: y)
        return F.transform(lines, lambda m, i: F.struct(m["line"].alias("line"), m["n"].alias("n"), line_rule(m, inside(i), seen).alias("rule")))

    return let(let(entry, runs), rules)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id with the base figures, the verdict, and the cleaned text.

    Null and blank texts have no words, so they fail the base rule of 20 words and are
    rejected. Repeated rows and ties are judged row by row; an empty table gives an empty table; other
    columns are ignored, whatever their names."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", "text", tidied(F.col("text")).alias("lines"), seen(F.col("text")).alias("seen"))
    ws = F.split(F.array_join(F.transform(F.filter("lines", lambda m: m["n"] > 0), lambda m: m["text"]), " "), " ")
    t = t.select("*", window_hashes(F.transform(ws, lambda w: F.xxhash64(w)), WINDOW).alias("windows"))
    t = t.select("doc_id", "text", "lines", "seen", repeated_window_words(F.col("windows")).alias("n_repeat_words"))  # not in a lambda: a distinct count is compiled here
    worded = F.filter("lines", lambda m: m["n"] > 0)
    total = lambda value: F.aggregate(worded, F.lit(0).cast("long"), lambda a, m: a + value(m))
    figures = F.struct(
        total(lambda m: m["n"]).alias("n_words"),
        total(lambda m: F.length(m["text"]) - m["n"] + 1).alias("word_chars"),
        F.col("seen.symbols").cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(F.transform(worded, lambda m: m["line"])))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words"),
        verdicts(F.col("lines"), F.col("seen")).alias("verdicts"),
        F.size(worded).cast("long").alias("n_lines"),
    )
    # A generated row: what follows reads the figures, and no filter on them makes them be worked out twice.
    out = t.select("doc_id", "text", F.explode(F.array(figures)).alias("f")).select("doc_id", "text", "f.*")
    out = out.select("*", F.filter("verdicts", lambda x: x["rule"].isNotNull()).alias("failed"))
    lost = lambda rule: F.aggregate(F.filter("failed", lambda x: x["rule"] == rule), F.lit(0), lambda a, x: a + x["n"]).cast("long")
    clean = F.array_join(F.transform(F.filter("verdicts", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    out = out.select("*", F.size("failed").cast("long").alias("n_failed_lines"), *[lost(r).alias(f"{r}_words") for r in ("punctuation", "navigation", "boilerplate")])
    gone = F.col("punctuation_words") + F.col("navigation_words") + F.col("boilerplate_words")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("lost_words", gone).withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (100 * F.col("lost_words") <= MAX_LOST_PERCENT * F.col("n_words"))
    return out.withColumn("kept", kept).withColumn("clean_text", F.when(F.col("n_failed_lines") == 0, F.col("text")).otherwise(clean)).drop("failed", "verdicts")


def keep_good_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass; their texts lose the failed lines, n_chars follows."""
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    j = judged(row).where("kept")
    cols = [F.col(f"doc_id.`{c}`").alias(c) for c in names]
    by = dict(zip(names, cols, strict=True)) | {"text": F.col("clean_text").alias("text"), "n_chars": F.length("clean_text").cast("long").alias("n_chars")}
    return j.select(*[by[c] for c in docs.columns])


def op2_line_quality(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("text", "clean_text")


_LIST = ", ".join("'" + p.replace("'", "''") + "'" for p in BOILERPLATE)
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN rep USING (doc_id, g)),
repeats AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
ln AS (SELECT doc_id, i, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
le AS (SELECT doc_id, i, t, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM ln),
lf AS (SELECT *, n > 0 AND n <= {MENU_WORDS} AND NOT regexp_matches(t, '[.!?:;,\x{{2026}}]$') AS entry FROM le),
lr AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, entry ORDER BY i) AS run FROM lf),
lm AS (SELECT doc_id, t, n, length(t) - length(translate(t, '#*$%&|<>', '')) AS symbols, entry AND count(*) OVER (PARTITION BY doc_id, entry, run) >= {MENU_LINES} AS menu,
        length(t) - length(translate(t, '{SEPARATORS}', '')) AS bars, length(t) - length(replace(t, '!!', '!')) AS shout,
        len(list_filter([{_LIST}], lambda p: contains(lower(t), p))) AS k FROM lr),
lv AS (SELECT doc_id, n, CASE WHEN t = '' THEN NULL WHEN bars >= 2 AND 3 * bars >= n OR menu THEN 'navigation'
        WHEN 100 * symbols >= {SYMBOL_PERCENT} * n THEN 'punctuation' WHEN n >= 3 AND 2 * shout >= n THEN 'punctuation'
        WHEN n > {HEADING_WORDS} AND NOT regexp_matches(t, '[.!?:;,"''\x{{2026}}\x{{bb}}\x{{201d}}\x{{2019}})\]\p{{L}}\p{{N}}]$') THEN 'punctuation'
        WHEN k >= 1 AND n <= {HEADING_WORDS} OR k >= 2 AND n <= {WORDS_PER_PHRASE} * k THEN 'boilerplate' END AS rule FROM lm),
lost AS (SELECT doc_id, count(rule) AS bad, coalesce(sum(n) FILTER (rule = 'punctuation'), 0)::BIGINT AS pw,
        coalesce(sum(n) FILTER (rule = 'navigation'), 0)::BIGINT AS nw, coalesce(sum(n) FILTER (rule = 'boilerplate'), 0)::BIGINT AS bw FROM lv GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, coalesce(bad, 0)::BIGINT AS n_failed_lines,
        coalesce(pw, 0) AS punctuation_words, coalesce(nw, 0) AS navigation_words, coalesce(bw, 0) AS boilerplate_words
      FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, punctuation_words + navigation_words + boilerplate_words AS lost_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
    AND 100 * (punctuation_words + navigation_words + boilerplate_words) <= {MAX_LOST_PERCENT} * n_words AS kept
FROM f
"""
