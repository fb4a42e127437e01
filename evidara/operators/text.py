"""Text normalisers, tokens, vocabularies, and text error and similarity metrics."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from evidara.plans.folding import folded
from evidara.plans.storage import staged
from evidara.plans.views import SPACES

#: Special tokens and their ids.
SPECIAL = ("<pad>", "<bos>", "<eos>", "<unk>")
PAD, BOS, EOS, UNK = range(4)


def norm_split(text: Column) -> Column:
    """The audit form: case folded, white space collapsed."""
    return F.trim(F.regexp_replace(folded(text), SPACES, " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(norm_split(text), 256)


def metric_form(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(StringType())
def norm_metric_exact(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else metric_form(x))


def norm_metric(text: Column) -> Column:
    """The metric form: NFKC, case folded, white space collapsed. ASCII texts, where the audit form is the same, stay in the JVM; Spark has no NFKC of its own."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, norm_split(text)).otherwise(norm_metric_exact(F.when(~plain, text)))


def metric_words(text: Column) -> Column:
    return F.filter(F.split(norm_metric(text), r"[^\p{L}\p{N}_']+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(norm_split(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def vocabulary(samples: DataFrame, text: str = "text") -> DataFrame:
    """(token, n, token_id) of the training texts, most frequent first, ids from 4 on.

    The ordering window holds the vocabulary, not the corpus."""
    t = samples.where("split = 'train'").select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return t.select("token", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + UNK).alias("token_id"))


def encoded(samples: DataFrame, vocab: DataFrame, text: str = "text", unknown: str = "unk") -> DataFrame:
    """(sample_id, pos, token_id), begin and end marks included; unknown tokens get id 3, or end the job where ``unknown`` is 'error'."""
    t = samples.select("sample_id", F.posexplode(F.concat(F.array(F.lit(SPECIAL[BOS])), tokens(F.col(text)), F.array(F.lit(SPECIAL[EOS])))).alias("pos", "token"))
    t = t.join(vocab.select("token", "token_id"), "token", "left")
    edge = F.when(F.col("token") == SPECIAL[BOS], BOS).when(F.col("token") == SPECIAL[EOS], EOS)  # no word looks like these
    other = F.lit(UNK) if unknown == "unk" else F.raise_error(F.concat(F.lit("unknown token: "), "token")).cast("int")
    return t.select("sample_id", "pos", F.coalesce(edge, F.col("token_id"), other).alias("token_id"))


def unknown_tokens(samples: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(sample_id, token, n) of what the error policy refuses: tokens that are not in the vocabulary."""
    t = samples.select("sample_id", F.explode(tokens(F.col(text))).alias("token")).groupBy("sample_id", "token").agg(F.count("*").alias("n"))
    return t.join(vocab.select("token"), "token", "left_anti").select("sample_id", "token", "n")


def detokenised(words: Column) -> Column:
    """Tokens joined by spaces, none before closing marks or after opening ones."""
    return F.regexp_replace(F.regexp_replace(F.array_join(words, " "), r" ([.,!?;:)\]}])", "$1"), r"([(\[{]) ", "$1")


def decoded(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """(sample_id, prediction_text) of ordered token ids; special ids are dropped, unknown ids raise no row."""
    t = ids.where(F.col("token_id") > UNK).join(vocab.select("token_id", "token"), "token_id")
    t = t.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return t.select("sample_id", detokenised(F.transform("t", lambda x: x["token"])).alias("prediction_text"))


#: So many entries of a vocabulary, its most frequent ones, are told to every task; only the others are joined.
HOT = 1 << 17


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _items(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists of a column, and how many each has."""
    return column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _found(hot: pa.Array):
    """Keys as their places among the ``hot`` ones, or below zero as places in ``rest``, which has each other key of a row once."""

    def run(batches):
        for b in batches:
            keys, n = _items(b.column("keys"))
            at = pc.index_in(keys.cast(hot.type), value_set=hot)
            miss = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            codes = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            named = keys.take(pa.array(miss)).dictionary_encode()
            wide = max(1, len(named.dictionary))
            pair, place = np.unique(np.repeat(np.arange(len(n)), n)[miss] * wide + named.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            row = pair // wide
            codes[miss] = -1 - (place - np.searchsorted(row, row, side="left")[place])
            rest = named.dictionary.take(pa.array(pair % wide))
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), _lists(pa.array(codes), n), _lists(rest, np.bincount(row, minlength=len(n)))], names=["sample_id", "codes", "rest"])

    return run


def _resolved(values: pa.Array):
    """Places back as the ``values`` of hot keys and of the row's ``hits``, null where a key has none."""

    def run(batches):
        for b in batches:
            codes, n = _items(b.column("codes"))
            rest, m = _items(b.column("rest"))
            hits, k = _items(b.column("hits"))
            row = lambda sizes: np.repeat(np.arange(b.num_rows), sizes)
            key, value = hits.field("key"), hits.field("value").cast(values.type)
            named = pa.concat_arrays([rest, key.cast(rest.type)]).dictionary_encode()
            wide, name = max(1, len(named.dictionary)), named.indices.to_numpy(zero_copy_only=False)
            asked, known = row(m) * wide + name[: len(rest)], row(k) * wide + name[len(rest) :]
            order = np.argsort(known)
            at = np.searchsorted(known[order], asked)
            at = np.where(at < len(known), at, -1)
            hit = order[at] if len(known) else np.zeros(len(asked), dtype=np.int64)
            hit = np.where((at >= 0) & (known[hit] == asked), hit, -1) if len(known) else np.full(len(asked), -1)
            every = pa.concat_arrays([values, value])
            c = codes.to_numpy(zero_copy_only=False).astype(np.int64)
            own = (np.cumsum(m) - m)[row(n)] - 1 - c  # where in ``rest``
            place = c.copy()
            low = c < 0
            place[low] = np.where(hit[own[low]] >= 0, len(values) + hit[own[low]], -1)
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), _lists(every.take(pa.array(place, mask=place < 0)), n)], names=["sample_id", "found"])

    return run


def looked_up(rows: DataFrame, table: DataFrame, hot: pa.Table) -> DataFrame:
    """(sample_id, found): the keys of (sample_id, keys) as their values in (key, value), null where there is none, order kept.

    Keys among the ``hot`` rows of the table stay where they are, as whole numbers; of the others each row's distinct ones are joined with the table."""
    kind = {c: table.schema[c].dataType.simpleString() for c in ("key", "value")}
    hot = hot.combine_chunks()
    own, values = hot.column("key").combine_chunks(), hot.column("value").combine_chunks()
    ident = rows.schema["sample_id"].dataType.simpleString()
    t = rows.mapInArrow(_found(own), f"sample_id {ident}, codes array<int>, rest array<{kind['key']}>")
    t = staged(t, "codes")
    hits = t.select("sample_id", F.explode("rest").alias("key")).distinct().join(table, "key").select("sample_id", F.struct("key", "value").alias("hit"))
    both = t.select("sample_id", F.struct("codes", "rest").alias("row"), F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"))
    both = both.unionByName(hits.withColumn("row", F.lit(None).cast(both.schema["row"].dataType)))
    both = both.groupBy("sample_id").agg(F.collect_list("row").alias("rows"), F.collect_list("hit").alias("hits"))
    both = both.select("sample_id", F.explode("rows").alias("row"), "hits").select("sample_id", "row.codes", "row.rest", "hits")
    return both.mapInArrow(_resolved(values), f"sample_id {ident}, found array<{kind['value']}>")


def _frequent(vocab: DataFrame, key: str, value: str) -> pa.Table:
    return vocab.where(F.col("token_id") <= HOT + UNK).select(F.col(key).alias("key"), F.col(value).alias("value")).toArrow()


def encoded_texts(samples: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """(sample_id, ids): what ``encoded`` gives with 'unk', in one row for each text. ``vocab`` is read several times."""
    t = samples.where(F.col(text).isNotNull()).select("sample_id", tokens(F.col(text)).alias("keys"))
    t = looked_up(t, vocab.select(F.col("token").alias("key"), F.col("token_id").alias("value")), _frequent(vocab, "token", "token_id"))
    return t.select("sample_id", F.concat(F.array(F.lit(BOS)), F.transform("found", lambda x: F.coalesce(x, F.lit(UNK))), F.array(F.lit(EOS))).alias("ids"))


def decoded_texts(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """(sample_id, prediction_text): what ``decoded`` gives, from (sample_id, ids). Rows of one sample are put together by position, then by token."""
    t = looked_up(ids.select("sample_id", F.col("ids").alias("keys")), vocab.select(F.col("token_id").alias("key"), F.col("token").alias("value")), _frequent(vocab, "token_id", "token"))
    if not ids.groupBy("sample_id").count().where("count > 1").isEmpty():
        pairs = F.flatten(F.collect_list(F.transform("found", lambda x, i: F.struct(i.alias("pos"), x.alias("token")))))
        t = t.groupBy("sample_id").agg(F.transform(F.array_sort(pairs), lambda x: x["token"]).alias("found"))
    return t.where(F.exists("found", lambda x: x.isNotNull())).select("sample_id", detokenised(F.col("found")).alias("prediction_text"))  # nulls are not joined


WORD = re.compile(r"[\w']+")

#: A user's tokenizer: any function of a text column to an array of words.
Tokenizer = Callable[[Column], Column]


def _by_words(predictions: DataFrame, tokenizer: Tokenizer | None, of_texts, of_words) -> Column:
    """A measure of each pair, over the metric's own words or those of ``tokenizer``."""
    hyp, ref = F.col("prediction_text"), F.col("reference_text")
    return of_texts(hyp, ref) if tokenizer is None else of_words(tokenizer(hyp), tokenizer(ref))


def edit_distance(a, b) -> int:
    """Levenshtein distance of two strings or lists, a whole row of the table in the bits of one number."""
    if a == b:
        return 0
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):  # the longer one lies in the bits, so there is a step for each unit of the shorter one only
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0  # where a cell is one more, or one less, than the cell above it
    for y in b:
        match = places.get(y, 0)
        step = (((match & up) + up) ^ up) | match
        more, less = (down | ~(step | up)) & full, up & step
        distance += bool(more & last) - bool(less & last)
        more, match = more << 1 | 1, match | down
        up, down = (less << 1 | ~(match | more)) & full, match & more & full
    return distance


def _pairs(measure):
    """A function of two text columns that normalises each pair once and returns whole numbers."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(hyp: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([None if h is None or r is None else measure(metric_form(h), metric_form(r)) for h, r in zip(hyp, ref, strict=True)])

    return run


edits = _pairs(lambda h, r: [edit_distance(h, r), len(r), edit_distance(x := WORD.findall(h), y := WORD.findall(r)), len(y), len(x)])
_chars = _pairs(lambda h, r: [edit_distance(h, r)])
_words = _pairs(lambda h, r: [edit_distance(WORD.findall(h), WORD.findall(r))])


def char_distance(a: Column, b: Column) -> Column:
    return _chars(a, b)[0].cast("int")


def word_distance(a: Column, b: Column) -> Column:
    return _words(a, b)[0].cast("int")


def corpus_error_rate(predictions: DataFrame) -> DataFrame:
    """CER and WER per run and control: edits summed over examples, divided by reference units summed."""
    p = predictions.select("run_id", "control", edits("prediction_text", "reference_text").alias("e"))
    rate = lambda k, n: F.when(F.sum(F.col("e")[n]) > 0, F.sum(F.col("e")[k]) / F.sum(F.col("e")[n])).when(F.sum(F.col("e")[k]) > 0, 1.0).otherwise(0.0)
    return p.groupBy("run_id", "control").agg(rate(0, 1).alias("cer"), rate(2, 3).alias("wer"), F.count("*").alias("examples"))


ORDERS = 4


def _clipped(a: list, b: list) -> list[int]:
    """Of each order the n-grams that both have and those of the hypothesis, then both lengths in words."""
    out = []
    for n in range(1, ORDERS + 1):
        x, y = Counter(zip(*(a[i:] for i in range(n)))), Counter(zip(*(b[i:] for i in range(n))))  # noqa: B905
        out += [sum((x & y).values()), sum(x.values())]
    return [*out, len(a), len(b)]


clipped_ngrams = _pairs(lambda h, r: _clipped(WORD.findall(h), WORD.findall(r)))


@F.pandas_udf(ArrayType(LongType()))
def _clipped_words(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or r is None else _clipped(list(h), list(r)) for h, r in zip(hyp, ref, strict=True)])


def corpus_bleu(predictions: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Corpus BLEU of effective order per run and control, without smoothing. N-grams are counted within a row, so only ten sums of a row are shuffled."""
    p = predictions.select("run_id", "control", _by_words(predictions, tokenizer, clipped_ngrams, _clipped_words).alias("c"))
    sums = p.groupBy("run_id", "control").agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(2 * ORDERS + 2)])
    pairs = [(F.col(f"c{2 * n}"), F.col(f"c{2 * n + 1}")) for n in range(ORDERS)]
    used = [t > 0 for _, t in pairs]
    logs = sum((F.when(u & (m > 0), F.log(m / t)).otherwise(0.0) for (m, t), u in zip(pairs, used, strict=True)), F.lit(0.0))
    n = sum((u.cast("int") for u in used), F.lit(0))
    hit = F.lit(True)
    for (m, _), u in zip(pairs, used, strict=True):
        hit = hit & (~u | (m > 0))
    hl, rl = F.col(f"c{2 * ORDERS}"), F.col(f"c{2 * ORDERS + 1}")
    bp = F.when(hl > rl, 1.0).otherwise(F.exp(1 - rl / hl))
    return sums.select("run_id", "control", F.when((n > 0) & hit, bp * F.exp(logs / n)).otherwise(0.0).alias("bleu"))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two arrays, by a fold that keeps one row of the table."""

    def step(row: Column, x: Column) -> Column:
        # struct(previous row, row so far): cell = diagonal + 1 on a match, else the larger neighbour
        start = F.struct(F.array(F.lit(0)).alias("cells"), F.lit(0).alias("i"))
        grown = F.aggregate(
            b,
            start,
            lambda s, y: F.struct(
                F.concat(
                    s["cells"],
                    F.array(F.when(x == y, F.get(row, s["i"]) + 1).otherwise(F.greatest(F.get(row, s["i"] + 1), F.get(s["cells"], s["i"])))),
                ).alias("cells"),
                (s["i"] + 1).alias("i"),
            ),
        )
        return grown["cells"]

    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda _: F.lit(0))
    return F.element_at(F.aggregate(a, zero, step), -1)


@F.pandas_udf(DoubleType())
def rouge_l_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    """ROUGE-L F1 of two word arrays; both empty is 1, one empty is 0, nothing in common is 0."""

    def one(x, y) -> float:
        if not len(x) or not len(y):
            return float(len(x) == len(y))
        masks: dict = {}
        for i, w in enumerate(x):
            masks[w] = masks.get(w, 0) | 1 << i
        full, v = (1 << len(x)) - 1, (1 << len(x)) - 1
        for w in y:  # bit-parallel longest common subsequence
            u = v & masks.get(w, 0)
            v = ((v + u) | (v - u)) & full
        n = len(x) - bin(v).count("1")
        return 2.0 * n / (len(x) + len(y)) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def rouge_l(predictions: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(run_id, control, sample_id, rouge_l) of each example."""
    words = tokenizer or metric_words
    return predictions.select("run_id", "control", "sample_id", rouge_l_f1(words(F.col("prediction_text")), words(F.col("reference_text"))).alias("rouge_l"))


#: Rows of the edit table kept apart; the rows between two of them are worked out again on the way back.
KEPT_ROWS = 256


def _path(h: list, r: list) -> tuple[int, int, int]:
    """(deletions, insertions, substitutions) of the path back through the edit table that prefers matches, then substitutions, deletions, insertions."""
    code = {w: i for i, w in enumerate(dict.fromkeys([*h, *r]))}
    a, b = np.array([code[w] for w in h], dtype=np.int64), np.array([code[w] for w in r], dtype=np.int64)
    at = np.arange(len(a) + 1)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (a != b[i]), row[1:] + 1)
        return np.minimum.accumulate(new - at) + at

    kept, row = {0: at}, at
    for i in range(max(0, len(b) - 1) // KEPT_ROWS * KEPT_ROWS):  # the rows after the last kept one are made on the way back
        row = below(row, i)
        if (i + 1) % KEPT_ROWS == 0:
            kept[i + 1] = row
    i, j, dele, ins, sub = len(b), len(a), 0, 0, 0
    first, rows = -1, []
    while i or j:
        if first < 0 or i < first or i > first + len(rows) - 1 or (i == first and first):
            first = max(0, i - 1) // KEPT_ROWS * KEPT_ROWS
            rows = [kept[first]]
            while len(rows) <= i - first:
                rows.append(below(rows[-1], first + len(rows) - 1))
        here = rows[i - first]
        above = rows[i - first - 1] if i else here
        if i and j and a[j - 1] == b[i - 1] and here[j] == above[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and here[j] == above[j - 1] + 1:
            i, j, sub = i - 1, j - 1, sub + 1
        elif i and here[j] == above[j] + 1:
            i, dele = i - 1, dele + 1
        else:
            j, ins = j - 1, ins + 1
    return dele, ins, sub


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("deletions", "insertions", "substitutions")]))
def word_edit_ops(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Counts of one optimal path; going back, a match is preferred, then substitution, deletion, insertion."""

    return pd.DataFrame([_path(list(h), list(r)) for h, r in zip(hyp, ref, strict=True)], columns=["deletions", "insertions", "substitutions"])


def _repeats_more(h: list, r: list) -> bool:
    """Whether a word comes more than once in the prediction, and more often than in the reference."""
    r = Counter(r)
    return any(n > 1 and n > r[w] for w, n in Counter(h).items())


@F.pandas_udf(StructType([*[StructField(c, LongType()) for c in ("deletions", "insertions", "substitutions")], StructField("repeated", BooleanType())]))
def _judged(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Edits and repetition of words joined by spaces, which are split a pair at a time; pairs that the rules before the edits decide have none counted."""

    def one(h: str | None, r: str | None) -> tuple:
        if h is None or r is None:
            return 0, 0, 0, _repeats_more((h or "").split(), [])
        h, r = h.split(" ") if h else [], r.split(" ") if r else []
        if h == r or not h or not r or set(h).isdisjoint(r):
            return 0, 0, 0, False
        if _repeats_more(h, r):
            return 0, 0, 0, True
        while h and r and h[-1] == r[-1]:  # the path back begins with these matches
            h.pop()
            r.pop()
        return *_path(h, r), False

    return pd.DataFrame([one(h, r) for h, r in zip(hyp, ref, strict=True)], columns=["deletions", "insertions", "substitutions", "repeated"])


#: The error categories.
CATEGORIES = ("exact", "empty", "omission", "substitution", "repetition", "hallucination")


def error_categories(predictions: DataFrame) -> DataFrame:
    """(run_id, control, sample_id, category) by rule precedence; word edits decide what the rules leave."""
    p = predictions.select("run_id", "control", "sample_id", metric_words(F.col("prediction_text")).alias("h"), metric_words(F.col("reference_text")).alias("r"))
    p = p.select("*", _judged(F.array_join("h", " "), F.array_join("r", " ")).alias("ops")).withColumn("repeated", F.col("ops.repeated"))
    d, i, s = F.col("ops.deletions"), F.col("ops.insertions"), F.col("ops.substitutions")
    category = (
        F.when(F.size("h") == 0, "empty")
        .when(F.array_join("h", " ") == F.array_join("r", " "), "exact")
        .when(F.size("r") == 0, "hallucination")
        .when(~F.arrays_overlap("h", "r"), "hallucination")
        .when(F.col("repeated"), "repetition")
        .when(F.col("h").isNull() | F.col("r").isNull(), None)
        .when((d > 0) & (i == 0) & (s == 0), "omission")
        .when((i > 0) & (d == 0) & (s == 0), "hallucination")
        .when((s > 0) & (d == 0) & (i == 0), "substitution")
        .when((d > i) & (d > s), "omission")
        .when((i > d) & (i > s), "hallucination")
        .otherwise("substitution")
    )
    return p.select("run_id", "control", "sample_id", category.alias("category"))


def taxonomy_summary(categories: DataFrame) -> DataFrame:
    """Count and rate of every category per run and control; those without examples are 0."""
    n = categories.groupBy("run_id", "control").agg(F.count("*").alias("total"))
    every = n.select("run_id", "control", "total", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    got = categories.groupBy("run_id", "control", "category").agg(F.count("*").alias("n"))
    out = every.join(got, ["run_id", "control", "category"], "left")
    return out.select("run_id", "control", "category", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("rate"))


def _meteor(h: list, r: list) -> float:
    """The k-th occurrence of a word on one side matches the k-th on the other, so a row is matched in one pass over positions."""
    if not h and not r:
        return 1.0
    places: dict = {}
    for j, w in enumerate(r):
        places.setdefault(w, []).append(j)
    used: dict = {}
    m = chunks = 0
    last = (-2, -2)
    for i, w in enumerate(h):
        k = used.get(w, 0)
        if k < len(places.get(w, ())):
            used[w], j = k + 1, places[w][k]
            m += 1
            chunks += (i, j) != (last[0] + 1, last[1] + 1)
            last = (i, j)
    if not m:
        return 0.0
    p, q = m / len(h), m / len(r)
    return 10 * p * q / (q + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


@F.pandas_udf(DoubleType())
def _meteor_texts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or r is None else _meteor(WORD.findall(metric_form(h)), WORD.findall(metric_form(r))) for h, r in zip(hyp, ref, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _meteor_words(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or r is None else _meteor(list(h), list(r)) for h, r in zip(hyp, ref, strict=True)], dtype="float64")


def meteor_unigram(predictions: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Greedy exact unigram METEOR per example: the k-th occurrence of a word matches the k-th. Nothing is shuffled."""
    score = _by_words(predictions, tokenizer, _meteor_texts, _meteor_words)
    return predictions.select("run_id", "control", "sample_id", score.alias("meteor"))
