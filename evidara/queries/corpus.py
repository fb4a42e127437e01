"""Queries over texts and samples: normalisers, vocabularies, audits, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import audit as A
from evidara.operators import splits as S
from evidara.operators import text as T
from evidara.plans.storage import staged
from evidara.plans.views import DUCK, view
from evidara.queries.registry import query

_NORM = DUCK["norm"]
_MWORDS = lambda x: f"list_filter(string_split_regex({_NORM(x)}, '[^\\p{{L}}\\p{{N}}_'']+'), lambda w: w <> '')"
_TOKENS = lambda x: f"regexp_extract_all({_NORM(x)}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"


def samples(spark, d):
    return view(spark, d, "samples").withColumn("group_ids", F.array("group_id"))


@query("select_split", ("samples",), "SELECT sample_id, split FROM samples WHERE split = 'validation'")
def select_split(spark, d):
    return samples(spark, d).where("split = 'validation'").select("sample_id", "split")


@query("multi_manifest_union", ("samples",), "SELECT sample_id, 'train' AS manifest FROM samples WHERE split = 'train' UNION ALL SELECT sample_id, 'test' FROM samples WHERE split = 'test'")
def multi_manifest_union(spark, d):
    s = samples(spark, d)
    part = lambda x: s.where(F.col("split") == x).select("sample_id", F.lit(x).alias("manifest"))
    return part("train").unionByName(part("test"), allowMissingColumns=True)


@query("norm_text_split", (), f"SELECT doc_id, md5({_NORM('text')}) AS norm, sha256({_NORM('text')}) AS fingerprint FROM documents")
def norm_text_split(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", F.md5(T.norm_split(F.col("text"))).alias("norm"), T.fingerprint(F.col("text")).alias("fingerprint"))


@query("norm_text_metric", (), f"SELECT doc_id, {_NORM('text')} AS norm FROM documents")
def norm_text_metric(spark, d):
    """The SQL has no compatibility forms; the given texts have no character that they change."""
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.norm_metric_exact("text").alias("norm"))


@query("metric_words", (), f"SELECT doc_id, len({_MWORDS('text')})::INT AS n, md5(array_to_string({_MWORDS('text')}, ' ')) AS words FROM documents")
def metric_words(spark, d):
    w = T.metric_words(F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


@query("tokenize", (), f"SELECT doc_id, len({_TOKENS('text')})::INT AS n, md5(array_to_string({_TOKENS('text')}, ' ')) AS tokens FROM documents")
def tokenize(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ")).alias("tokens"))


_VOCAB = f"""vocab AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) + 3 AS token_id
  FROM (SELECT unnest({_TOKENS('text')}) AS token FROM samples WHERE split = 'train') GROUP BY token)"""


@query("vocabulary_fit", ("samples",), f"WITH {_VOCAB} SELECT token, n, token_id FROM vocab")
def vocabulary_fit(spark, d):
    return T.vocabulary(samples(spark, d))


_ENCODED = f"""enc AS (SELECT sample_id, pos, CASE WHEN token = '<bos>' THEN 1 WHEN token = '<eos>' THEN 2 ELSE coalesce(token_id, 3) END AS token_id
  FROM (SELECT sample_id, unnest(range(len(ts) + 2)) AS pos, unnest(list_concat(list_concat(['<bos>'], ts), ['<eos>'])) AS token
        FROM (SELECT sample_id, {_TOKENS('text')} AS ts FROM samples)) LEFT JOIN vocab USING (token))"""


@query("encode_tokens", ("samples",), f"WITH {_VOCAB}, {_ENCODED} SELECT sample_id, count(*) AS n, sum(token_id * (pos + 1))::BIGINT AS checksum, count(*) FILTER (token_id = 3) AS unknown FROM enc GROUP BY sample_id")
def encode_tokens(spark, d):
    s = samples(spark, d)
    e = T.encoded(s, T.vocabulary(s))
    return e.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(F.col("token_id").cast("long") * (F.col("pos") + 1)).cast("long").alias("checksum"), F.count_if(F.col("token_id") == 3).alias("unknown"))


@query("encode_tokens_strict", ("samples",), f"WITH {_VOCAB} SELECT sample_id, token, count(*) AS n FROM (SELECT sample_id, unnest({_TOKENS('text')}) AS token FROM samples) ANTI JOIN vocab USING (token) GROUP BY sample_id, token")
def encode_tokens_strict(spark, d):
    """What the error policy of the encoding refuses. Every token of a training sample is in the vocabulary fitted on it, so those rows are not asked again."""
    s = samples(spark, d)
    return T.unknown_tokens(s.where("split is null or split <> 'train'"), T.vocabulary(s))


@query(
    "prediction_from_tokens",
    ("samples",),
    f"""WITH {_VOCAB}, {_ENCODED}, dec AS (SELECT sample_id, string_agg(token, ' ' ORDER BY pos) AS t FROM enc JOIN vocab USING (token_id) GROUP BY sample_id)
    SELECT sample_id, md5(regexp_replace(regexp_replace(t, ' ([.,!?;:)\\]}}])', '\\1', 'g'), '([(\\[{{]) ', '\\1', 'g')) AS prediction FROM dec""",
)
def prediction_from_tokens(spark, d):
    s = samples(spark, d)
    v = staged(T.vocabulary(s).select("token", "token_id"), "vocabulary")
    return T.decoded_texts(staged(T.encoded_texts(s, v), "ids"), v).select("sample_id", F.md5("prediction_text").alias("prediction"))


_CHARCODE = "array_to_string(list_transform(string_split({x}, ''), lambda c: chr(list_position(t, c)::INT)), '')"


@query(
    "char_edit_distance",
    ("predictions",),
    f"""WITH p AS (SELECT sample_id, control, {_NORM('prediction_text')} AS a, {_NORM('reference_text')} AS b FROM predictions),
    q AS (SELECT *, list_distinct(string_split(a || b, '')) AS t FROM p)
    SELECT sample_id, control, levenshtein({_CHARCODE.format(x='a')}, {_CHARCODE.format(x='b')})::INT AS distance FROM q""",
)
def char_edit_distance(spark, d):
    return view(spark, d, "predictions").select("sample_id", "control", T.char_distance(F.col("prediction_text"), F.col("reference_text")).alias("distance"))


#: Words that both sides have become one byte each, others one of two bytes that match nothing: then DuckDB's Levenshtein, which counts bytes, counts words.
#: Pairs that share more words than there are bytes go through the edit table, a row for each word of the reference.
DISTANCES = f"""p AS MATERIALIZED (SELECT row_number() OVER () AS id, run_id, control, sample_id, {_NORM('prediction_text')} AS ch, {_NORM('reference_text')} AS cr, {_MWORDS('prediction_text')} AS h, {_MWORDS('reference_text')} AS r FROM predictions),
 shared AS MATERIALIZED (SELECT *, list_intersect(list_distinct(h), list_distinct(r)) AS t, list_distinct(string_split(ch || cr, '')) AS ct FROM p),
 far AS MATERIALIZED (SELECT id, list_transform(h, lambda w: list_position(t, w)) AS h, list_transform(r, lambda w: coalesce(list_position(t, w), -1)) AS r FROM shared WHERE len(t) > 124),
 cells AS (SELECT id, 0 AS i, unnest(range(len(h) + 1)) AS j, unnest(range(len(h) + 1)) AS v FROM far
  UNION ALL SELECT id, i, j, j + min(least(e, up + 1) - j) OVER (PARTITION BY id ORDER BY j)
  FROM (SELECT c.id, c.i + 1 AS i, c.j, c.v AS up, lag(c.v) OVER (PARTITION BY c.id ORDER BY c.j) + coalesce(far.h[c.j] <> far.r[c.i + 1], true)::INT AS e FROM cells c JOIN far USING (id) WHERE c.i < len(far.r))),
 distances AS MATERIALIZED (SELECT s.*, levenshtein({_CHARCODE.format(x='ch').replace('list_position(t,', 'list_position(ct,')}, {_CHARCODE.format(x='cr').replace('list_position(t,', 'list_position(ct,')}) AS cd, CASE WHEN len(t) > 124 THEN v
   ELSE levenshtein(array_to_string(list_transform(h, lambda w: chr(coalesce(list_position(t, w), 125)::INT)), ''), array_to_string(list_transform(r, lambda w: chr(coalesce(list_position(t, w), 126)::INT)), '')) END AS wd
  FROM shared s LEFT JOIN (SELECT c.id, c.v FROM cells c JOIN far f USING (id) WHERE c.i = len(f.r) AND c.j = len(f.h)) c USING (id)),
 rates AS (SELECT run_id, control, CASE WHEN sum(length(cr)) > 0 THEN sum(cd) / sum(length(cr)) WHEN sum(cd) > 0 THEN 1 ELSE 0 END AS cer, CASE WHEN sum(len(r)) > 0 THEN sum(wd) / sum(len(r)) WHEN sum(wd) > 0 THEN 1 ELSE 0 END AS wer, count(*) AS examples FROM distances GROUP BY run_id, control)"""


@query("word_edit_distance", ("predictions",), f"WITH RECURSIVE {DISTANCES} SELECT sample_id, control, wd::INT AS distance FROM distances")
def word_edit_distance(spark, d):
    return view(spark, d, "predictions").select("sample_id", "control", T.word_distance(F.col("prediction_text"), F.col("reference_text")).alias("distance"))


@query("corpus_error_rate", ("predictions",), f"WITH RECURSIVE {DISTANCES} SELECT run_id, control, round(cer, 6)::DOUBLE AS cer, round(wer, 6)::DOUBLE AS wer, examples FROM rates")
def corpus_error_rate(spark, d):
    r = T.corpus_error_rate(view(spark, d, "predictions"))
    return r.select("run_id", "control", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"), "examples")


_BLEU = f"""p AS (SELECT run_id, control, sample_id, {_MWORDS('prediction_text')} AS h, {_MWORDS('reference_text')} AS r FROM predictions),
 o AS (SELECT unnest([1, 2, 3, 4]) AS n),
 hg AS (SELECT run_id, control, sample_id, n, g, count(*) AS ch FROM (SELECT run_id, control, sample_id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM p, o) GROUP BY ALL),
 rg AS (SELECT run_id, control, sample_id, n, g, count(*) AS cr FROM (SELECT run_id, control, sample_id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM p, o) GROUP BY ALL),
 m AS (SELECT run_id, control, n, sum(least(ch, coalesce(cr, 0))) AS m, sum(ch) AS t FROM hg LEFT JOIN rg USING (run_id, control, sample_id, n, g) GROUP BY run_id, control, n),
 l AS (SELECT run_id, control, min(m) AS least, avg(ln(m / t)) FILTER (m > 0) AS lp FROM m GROUP BY run_id, control),
 z AS (SELECT run_id, control, sum(len(h)) AS hl, sum(len(r)) AS rl FROM p GROUP BY run_id, control)"""


@query(
    "corpus_bleu",
    ("predictions",),
    f"WITH {_BLEU} SELECT run_id, control, round(CASE WHEN coalesce(least, 0) > 0 THEN exp(lp) * CASE WHEN hl > rl THEN 1 ELSE exp(1 - rl / hl) END ELSE 0 END, 6)::DOUBLE AS bleu FROM z LEFT JOIN l USING (run_id, control)",
)
def corpus_bleu(spark, d):
    return T.corpus_bleu(view(spark, d, "predictions")).select("run_id", "control", F.round("bleu", 6).alias("bleu"))


@query("rouge_l")
def rouge_l(spark, d):
    p = view(spark, d, "predictions")
    return p.select("run_id", "control", "sample_id", F.round(T.rouge_l_f1(T.metric_words(F.col("prediction_text")), T.metric_words(F.col("reference_text"))), 6).alias("rouge_l"))


@query(
    "meteor_unigram",
    ("predictions",),
    f"""WITH p AS (SELECT control, sample_id, {_MWORDS('prediction_text')} AS h, {_MWORDS('reference_text')} AS r FROM predictions),
    a AS (SELECT *, row_number() OVER (PARTITION BY control, sample_id, w ORDER BY i) AS k FROM (SELECT control, sample_id, unnest(h) AS w, unnest(range(len(h))) AS i FROM p)),
    b AS (SELECT *, row_number() OVER (PARTITION BY control, sample_id, w ORDER BY j) AS k FROM (SELECT control, sample_id, unnest(r) AS w, unnest(range(len(r))) AS j FROM p)),
    m AS (SELECT control, sample_id, i, j, lag(i) OVER o AS pi, lag(j) OVER o AS pj FROM a JOIN b USING (control, sample_id, w, k) WINDOW o AS (PARTITION BY control, sample_id ORDER BY i)),
    g AS (SELECT control, sample_id, count(*) AS m, sum(CASE WHEN i = pi + 1 AND j = pj + 1 THEN 0 ELSE 1 END) AS chunks FROM m GROUP BY control, sample_id)
    SELECT control, sample_id, round(CASE WHEN len(h) = 0 AND len(r) = 0 THEN 1 WHEN m IS NULL THEN 0 ELSE
      10 * (m / len(h)) * (m / len(r)) / ((m / len(r)) + 9 * (m / len(h))) * (1 - 0.5 * pow(chunks / m, 3)) END, 6)::DOUBLE AS meteor FROM p LEFT JOIN g USING (control, sample_id)""",
)
def meteor_unigram(spark, d):
    return T.meteor_unigram(view(spark, d, "predictions")).select("control", "sample_id", F.round("meteor", 6).alias("meteor"))


@query("word_edit_ops")
def word_edit_ops(spark, d):
    p = view(spark, d, "predictions")
    ops = T.word_edit_ops(T.metric_words(F.col("prediction_text")), T.metric_words(F.col("reference_text")))
    return p.select("control", "sample_id", ops.alias("ops")).select("control", "sample_id", "ops.*")


#: What the rules before the edit path leave is decided by its counts: going back, a match is preferred, then substitution, deletion, insertion. Pure
#: deletions are subsequences, and where lengths are equal there are as many deletions as insertions, so few pairs need a path.
CATEGORIES = f"""p AS MATERIALIZED (SELECT row_number() OVER () AS id, run_id, control, sample_id, {_MWORDS('prediction_text')} AS h, {_MWORDS('reference_text')} AS r FROM predictions),
 n AS (SELECT id, bool_or(x > 1 AND x > y) AS repeated FROM (SELECT id, w, count(*) FILTER (own) AS x, count(*) FILTER (NOT own) AS y FROM (SELECT id, unnest(h) AS w, true AS own FROM p UNION ALL SELECT id, unnest(r), false FROM p) GROUP BY id, w) GROUP BY id),
 within AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(h, lambda w: list_position(list_concat(h, r), w)::BIGINT)), lambda pos, w: CASE WHEN pos > len(r) THEN pos ELSE pos + coalesce(nullif(list_position(r[pos + 1:], list_concat(h, r)[w]), 0), 1000000) END) <= len(r) AS deleted,
   list_reduce(list_prepend(0::BIGINT, list_transform(r, lambda w: list_position(list_concat(h, r), w)::BIGINT)), lambda pos, w: CASE WHEN pos > len(h) THEN pos ELSE pos + coalesce(nullif(list_position(h[pos + 1:], list_concat(h, r)[w]), 0), 1000000) END) <= len(h) AS inserted FROM p),
 ruled AS MATERIALIZED (SELECT p.*, CASE WHEN len(h) = 0 THEN 'empty' WHEN h = r THEN 'exact' WHEN len(r) = 0 OR len(list_intersect(h, r)) = 0 THEN 'hallucination' WHEN repeated THEN 'repetition'
   WHEN deleted THEN 'omission' WHEN inserted THEN 'hallucination' WHEN len(h) = len(r) THEN 'substitution' END AS rule FROM p LEFT JOIN n USING (id) LEFT JOIN within USING (id)),
 k AS MATERIALIZED (SELECT id, list_transform(h, lambda w: list_position(t, w)) AS h, list_transform(r, lambda w: list_position(t, w)) AS r FROM (SELECT *, list_distinct(list_concat(h, r)) AS t FROM ruled WHERE rule IS NULL)),
 cells AS (SELECT id, 0 AS i, unnest(range(len(h) + 1)) AS j, unnest(range(len(h) + 1)) AS v, 0::BIGINT AS d, unnest(range(len(h) + 1)) AS n, 0::BIGINT AS s FROM k
  UNION ALL SELECT id, i, j, v, coalesce(d, last_value(d IGNORE NULLS) OVER o), coalesce(n, last_value(n - j IGNORE NULLS) OVER o + j), coalesce(s, last_value(s IGNORE NULLS) OVER o)
  FROM (SELECT id, i, j, v, CASE WHEN v = e THEN de WHEN v = up + 1 THEN d + 1 END AS d, CASE WHEN v = e THEN ne WHEN v = up + 1 THEN n END AS n, CASE WHEN v = e THEN se + x WHEN v = up + 1 THEN s END AS s
   FROM (SELECT *, j + min(least(e, up + 1) - j) OVER (PARTITION BY id ORDER BY j) AS v
    FROM (SELECT c.id, c.i + 1 AS i, c.j, c.v AS up, c.d, c.n, c.s, (k.h[c.j] <> k.r[c.i + 1])::INT AS x, lag(c.v) OVER w + (k.h[c.j] <> k.r[c.i + 1])::INT AS e, lag(c.d) OVER w AS de, lag(c.n) OVER w AS ne, lag(c.s) OVER w AS se
     FROM cells c JOIN k USING (id) WHERE c.i < len(k.r) WINDOW w AS (PARTITION BY c.id ORDER BY c.j)))) WINDOW o AS (PARTITION BY id ORDER BY j)),
 paths AS (SELECT id, CASE WHEN d > n AND d > s THEN 'omission' WHEN n > d AND n > s THEN 'hallucination' ELSE 'substitution' END AS path FROM cells JOIN k USING (id) WHERE i = len(k.r) AND j = len(k.h)),
 categories AS MATERIALIZED (SELECT run_id, control, sample_id, coalesce(rule, path) AS category FROM ruled LEFT JOIN paths USING (id))"""


@query("error_category", ("predictions",), f"WITH RECURSIVE {CATEGORIES} SELECT run_id, control, sample_id, category FROM categories")
def error_category(spark, d):
    return T.error_categories(view(spark, d, "predictions"))


@query(
    "error_taxonomy_summary",
    ("predictions",),
    f"""WITH RECURSIVE {CATEGORIES}, t AS (SELECT run_id, control, count(*) AS total FROM categories GROUP BY run_id, control), c AS (SELECT unnest({list(T.CATEGORIES)}) AS category)
    SELECT t.run_id, t.control, c.category, count(g.sample_id) AS n, count(g.sample_id) / any_value(total) AS rate FROM t CROSS JOIN c LEFT JOIN categories g ON g.run_id = t.run_id AND g.control = t.control AND g.category = c.category GROUP BY t.run_id, t.control, c.category""",
)
def error_taxonomy_summary(spark, d):
    return T.taxonomy_summary(T.error_categories(view(spark, d, "predictions")))


@query("frequency_baseline", ("samples",), "SELECT text FROM (SELECT text, count(*) AS n FROM samples WHERE split = 'train' GROUP BY text) ORDER BY n DESC, text LIMIT 1")
def frequency_baseline(spark, d):
    t = samples(spark, d).where("split = 'train'").groupBy("text").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "text").limit(1).select("text")


@query("constant_baseline", ("samples",), "SELECT sample_id, (SELECT md5(text) FROM (SELECT text, count(*) AS n FROM samples WHERE split = 'train' GROUP BY text) ORDER BY n DESC, text LIMIT 1) AS prediction FROM samples WHERE split = 'test'")
def constant_baseline(spark, d):
    one = frequency_baseline(spark, d).select(F.md5("text").alias("prediction"))
    return samples(spark, d).where("split = 'test'").select("sample_id").crossJoin(F.broadcast(one))  # one row


_FIND = "SELECT '{code}' AS code, '{sev}' AS severity, key, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS sample_ids, array_to_string(list_sort(list(DISTINCT split) FILTER (split IS NOT NULL)), ',') AS splits FROM (SELECT {key} AS key, sample_id, split FROM samples) GROUP BY key HAVING count(DISTINCT split) > 1"
_GROUP, _DUP = _FIND.format(code="group_across_splits", sev="error", key="group_id"), _FIND.format(code="duplicate_target_text", sev="error", key="fingerprint")
_MISSING = """SELECT 'missing_split' AS code, 'error' AS severity, sample_id AS key, sample_id AS sample_ids, '' AS splits FROM samples WHERE split IS NULL
 UNION ALL SELECT 'duplicate_sample', 'error', sample_id, sample_id, coalesce(split, '') FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY idx) AS n FROM samples) WHERE n > 1"""
_PRE = """SELECT 'pretraining_overlap' AS code, 'error' AS severity, concat(CASE WHEN a.value IS NOT NULL THEN 'sample' ELSE 'text' END, ':', sample_id) AS key, sample_id AS sample_ids, coalesce(split, '') AS splits
 FROM samples LEFT JOIN (SELECT value FROM exposure WHERE kind = 'sample') a ON a.value = sample_id LEFT JOIN (SELECT value FROM exposure WHERE kind = 'text') b ON b.value = fingerprint WHERE a.value IS NOT NULL OR b.value IS NOT NULL"""


def flat(findings):
    return findings.select("code", "severity", "key", F.array_join("sample_ids", ",").alias("sample_ids"), F.array_join("splits", ",").alias("splits"))


@query("group_across_splits", ("samples",), _GROUP)
def group_across_splits(spark, d):
    return flat(A.group_across_splits(samples(spark, d)))


@query("duplicate_target_text", ("samples",), _DUP)
def duplicate_target_text(spark, d):
    return flat(A.duplicate_target_text(samples(spark, d)))


@query("duplicate_and_missing", ("samples",), _MISSING)
def duplicate_and_missing(spark, d):
    return flat(A.duplicate_and_missing(samples(spark, d)))


@query("pretraining_overlap", ("samples", "exposure"), _PRE)
def pretraining_overlap(spark, d):
    return flat(A.pretraining_overlap(samples(spark, d), view(spark, d, "exposure")))


_OVER = """SELECT l.event_id FROM windows l JOIN windows r ON l.recording_id = r.recording_id AND (l.start_s, l.event_id) < (r.start_s, r.event_id) AND l.start_s < r.end_s AND r.start_s < l.end_s AND l.split <> r.split"""
_ACCESS = "access AS (SELECT source AS dataset_id, count(*) % 2 = 0 AS text_at_inference, count(*) % 3 = 0 AS context_at_inference, min(doc_id) % 5 = 0 AS audio_at_inference, min(doc_id) % 2 = 0 AS token_boundaries, max(doc_id) % 3 = 0 AS event_boundaries FROM documents GROUP BY source)"
_RULES = (("text_at_inference", "error"), ("context_at_inference", "error"), ("audio_at_inference", "error"), ("token_boundaries", "warning"), ("event_boundaries", "warning"))
_ACCESS_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS code, '{s}' AS severity, dataset_id AS key FROM access WHERE {c}" for c, s in _RULES)


@query(
    "split_audit",
    ("samples", "exposure", "windows"),
    f"""WITH {_ACCESS} SELECT code, severity, count(*) AS n, sum(len(string_split(sample_ids, ',')))::BIGINT AS n_samples FROM ({_GROUP} UNION ALL {_DUP} UNION ALL {_MISSING} UNION ALL {_PRE}) GROUP BY code, severity
    UNION ALL SELECT 'interval_overlap', 'error', count(*), (2 * count(*))::BIGINT FROM ({_OVER}) HAVING count(*) > 0
    UNION ALL SELECT code, severity, count(*), 0 FROM ({_ACCESS_ROWS}) GROUP BY code, severity""",
)
def split_audit(spark, d):
    s = staged(samples(spark, d).drop("text"), "samples")  # texts are hashed once for all audits
    return A.split_audit_counts(s, view(spark, d, "exposure"), view(spark, d, "windows"), access(spark, d))


@query("information_access_check", (), f"WITH {_ACCESS} {_ACCESS_ROWS}")
def information_access_check(spark, d):
    return A.information_access(access(spark, d)).select("code", "severity", "key")


def access(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(F.col("source").alias("dataset_id")).agg(
        (F.count("*") % 2 == 0).alias("text_at_inference"), (F.count("*") % 3 == 0).alias("context_at_inference"), (F.min("doc_id") % 5 == 0).alias("audio_at_inference"),
        (F.min("doc_id") % 2 == 0).alias("token_boundaries"), (F.max("doc_id") % 3 == 0).alias("event_boundaries"),
    )


_HASHED = "row_number() OVER (ORDER BY sha256(concat_ws(':', '{seed}', {col}::VARCHAR)), {col})"


@query("split_hash_order", ("samples",), f"SELECT subject_id, {_HASHED.format(seed='0', col='subject_id')} AS place FROM (SELECT DISTINCT subject_id FROM samples)")
def split_hash_order(spark, d):
    return S.seeded_rank(samples(spark, d).select("subject_id").distinct(), "subject_id", "0").select("subject_id", F.col("place").cast("long").alias("place"))


_LOSO = """held AS (SELECT * FROM samples WHERE subject_id = 'src0'), {excl}
 rest AS (SELECT * FROM samples WHERE subject_id <> 'src0' {cond}),
 u AS (SELECT fingerprint, row_number() OVER (ORDER BY sha256(concat_ws(':', '0', fingerprint)), fingerprint) AS place FROM (SELECT DISTINCT fingerprint FROM rest)),
 n AS (SELECT least(greatest(1, round_even(count(*) * 0.1, 0)), count(*) - 1) AS v FROM u),
 plan AS (SELECT sample_id, 'test' AS split FROM held {union} UNION ALL SELECT sample_id, CASE WHEN place <= v THEN 'validation' ELSE 'train' END FROM rest JOIN u USING (fingerprint), n)"""
_LOSO_PLAIN = _LOSO.format(excl="", cond="", union="")
_LOSO_UNIQUE = _LOSO.format(excl="", cond="AND fingerprint NOT IN (SELECT fingerprint FROM held)", union="UNION ALL SELECT sample_id, 'excluded' FROM samples WHERE subject_id <> 'src0' AND fingerprint IN (SELECT fingerprint FROM held)")


@query("split_loso", ("samples",), f"WITH {_LOSO_PLAIN} SELECT sample_id, split FROM plan")
def split_loso(spark, d):
    return S.leave_one_out(samples(spark, d), "src0")


@query("split_loso_unique_text", ("samples",), f"WITH {_LOSO_UNIQUE} SELECT sample_id, split FROM plan")
def split_loso_unique_text(spark, d):
    return S.leave_one_out(samples(spark, d), "src0", unique_text=True)


@query("split_materialize", ("samples",), f"WITH {_LOSO_UNIQUE} SELECT plan.split, subject_id, count(*) AS n FROM plan JOIN samples USING (sample_id) WHERE plan.split <> 'excluded' GROUP BY ALL")
def split_materialize(spark, d):
    s = samples(spark, d)
    return S.materialize(s, S.leave_one_out(s, "src0", unique_text=True)).groupBy("split", "subject_id").agg(F.count("*").alias("n"))


@query("plan_coverage", ("samples",), "SELECT sample_id, 'missing' AS code FROM samples WHERE split IS NULL UNION ALL SELECT 'x' || sample_id, 'unknown' FROM samples WHERE split = 'validation'")
def plan_coverage(spark, d):
    s = samples(spark, d)
    plan = s.where("split is not null").select("sample_id").unionByName(s.where("split = 'validation'").select(F.concat(F.lit("x"), F.col("sample_id")).alias("sample_id")))
    return S.plan_coverage(s, plan)


@query(
    "artifact_checksum_audit",
    (),
    """WITH e AS (SELECT source || '/' || doc_id || '.json' AS uri, sha256(coalesce(text, '')) AS actual, text, CASE WHEN doc_id % 53 = 0 THEN 'bad' WHEN doc_id % 59 = 0 THEN repeat('0', 64) ELSE sha256(coalesce(text, '')) END AS expected FROM documents)
    SELECT uri, CASE WHEN NOT regexp_full_match(expected, '[0-9a-f]{64}') THEN 'malformed_checksum' WHEN coalesce(text, '') = '' THEN 'empty' WHEN expected <> actual THEN 'mismatch' END AS code FROM e
    WHERE NOT regexp_full_match(expected, '[0-9a-f]{64}') OR coalesce(text, '') = '' OR expected <> actual""",
)
def artifact_checksum_audit(spark, d):
    from evidara.sources.files import checksum_findings

    t = spark.read.parquet(f"{d}/documents.parquet")
    uri, content = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".json")), F.coalesce("text", F.lit(""))
    sha = F.sha2(content, 256)
    expected = t.select(uri.alias("uri"), F.when(F.col("doc_id") % 53 == 0, "bad").when(F.col("doc_id") % 59 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(sha).alias("expected"))
    return checksum_findings(expected, t.select(uri.alias("uri"), content.cast("binary").alias("content")))


@query(
    "manifest_digest",
    (),
    """WITH r AS (SELECT source, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(lang, ''), coalesce(text, ''))) AS h FROM documents)
    SELECT source, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT source || '/' || substr(h, 1, 2) AS source, h FROM r) GROUP BY source""",
)
def manifest_digest(spark, d):
    from evidara.sources.files import table_digest

    t = spark.read.parquet(f"{d}/documents.parquet")
    return table_digest(t, F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))), "source")


@query(
    "manifest_digest_tree",
    (),
    """WITH RECURSIVE h AS (SELECT source, h, count(*) AS k FROM (SELECT source, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(lang, ''), coalesce(text, ''))) AS h FROM documents) GROUP BY source, h),
    l AS (SELECT min(l) AS l FROM (SELECT unnest(range(20)) AS l), (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM h GROUP BY source)) WHERE n <= 8 * 16 ** l),
    t AS (SELECT source, substr(h, 1, l) AS p, l AS size, sha256(string_agg(h || ':' || k::VARCHAR, ',' ORDER BY h)) AS d, sum(k)::BIGINT AS n FROM h, l GROUP BY source, substr(h, 1, l), l
      UNION ALL SELECT source, substr(p, 1, size - 1), size - 1, sha256(string_agg(d, ',' ORDER BY p)), sum(n)::BIGINT FROM t WHERE size > 0 GROUP BY source, substr(p, 1, size - 1), size)
    SELECT source, n, d AS digest FROM t WHERE size = 0""",
)
def manifest_digest_tree(spark, d):
    """One digest for each source; leaves of about eight rows."""
    from evidara.sources.files import tree_digest

    t = spark.read.parquet(f"{d}/documents.parquet")
    return tree_digest(t, F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))), "source", leaf=8)


@query(
    "recording_inventory",
    (),
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS task, regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS subject FROM pages)
    SELECT task, count(*) AS files, count(DISTINCT nullif(subject, '')) AS subjects, count(*) FILTER (subject = '') AS unparsable,
      count(*) - count(DISTINCT (host, subject)) AS duplicates FROM p GROUP BY task""",
)
def recording_inventory(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("task"), F.regexp_extract("url", "^https?://[^/]+/[a-z]+/([0-9]+)", 1).alias("subject")
    )
    return p.groupBy("task").agg(F.count("*").alias("files"), F.count_distinct(F.nullif("subject", F.lit(""))).alias("subjects"), F.count_if(F.col("subject") == "").alias("unparsable"), (F.count("*") - F.count_distinct("host", "subject")).alias("duplicates"))


@query(
    "recording_inventory_findings",
    (),
    """WITH p AS (SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) AS version, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS task, regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) AS subject FROM pages)
    SELECT 'unparsable_subject' AS code, url AS key FROM p WHERE subject = '' UNION ALL SELECT 'duplicate_subject', concat_ws('/', task, version, subject) FROM p WHERE subject <> '' GROUP BY task, version, subject HAVING count(*) > 1
    UNION ALL SELECT 'several_versions', task FROM p GROUP BY task HAVING count(DISTINCT version) > 1
    UNION ALL SELECT 'partial_task_set', subject FROM p WHERE subject <> '' GROUP BY subject HAVING count(DISTINCT task) < (SELECT count(DISTINCT task) FROM p)""",
)
def recording_inventory_findings(spark, d):
    """Hosts stand for versions, languages for tasks, page numbers for subjects."""
    from evidara.sources.files import inventory_findings

    at = lambda pattern: F.regexp_extract("url", pattern, 1)
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("url").alias("path"), at("^https?://[^/]+/([a-z]+)/").alias("task"), at("^https?://([^/]+)").alias("version"), at("^https?://[^/]+/[a-z]+/([0-9]+)").alias("subject"))
    return inventory_findings(p)


@query(
    "data_quality_summary",
    ("samples",),
    "SELECT coalesce(split, 'none') AS split, count(*) AS samples, count(DISTINCT subject_id) AS subjects, count(*) FILTER (trim(text) = '') AS blank, round(avg(length(text)), 6) AS mean_chars FROM samples GROUP BY ALL",
)
def data_quality_summary(spark, d):
    s = samples(spark, d)
    return s.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count("*").alias("samples"), F.count_distinct("subject_id").alias("subjects"), F.count_if(F.trim("text") == "").alias("blank"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


