"""Queries over signals: the embeddings seen as 8 channels of 8 steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.operators import signals as G
from evidara.plans.views import view
from evidara.queries.registry import query


def cells(spark, d):
    return view(spark, d, "cells")


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df, *keys):
    return df.select(*keys, F.round("value", 6).alias("value"))


_U = lambda seed, *k: f"(('0x' || substr(sha256(concat_ws(':', '{seed}', {', '.join(f'{x}::VARCHAR' for x in k)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_N = lambda seed, *k: f"(sqrt(-2 * ln(greatest({_U(seed + '-a', *k)}, 1e-12))) * cos(2 * pi() * {_U(seed + '-b', *k)}))"
_OK = "channel_ok AND time_ok"
_STATS = f"stats AS (SELECT channel, avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS scale FROM cells WHERE split = 'train' AND {_OK} GROUP BY channel)"


@query("channel_normalizer_fit", ("cells",), f"WITH {_STATS} SELECT channel::INT AS channel, round(mean, 6) AS mean, round(scale, 6) AS scale FROM stats")
def channel_normalizer_fit(spark, d):
    return G.fit_normalizer(cells(spark, d)).select("channel", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query(
    "channel_normalizer_findings",
    ("cells",),
    f"""WITH c AS (SELECT *, CASE WHEN vec_id % 11 = 0 AND channel = 7 THEN NULL ELSE channel END AS ch, channel_ok AND channel <> 5 AS ok FROM cells), k AS (SELECT * FROM c WHERE ch IS NOT NULL)
    SELECT DISTINCT 'non_train_sample' AS code, vec_id::VARCHAR AS key FROM k WHERE split <> 'train' UNION ALL SELECT 'channel_count', vec_id::VARCHAR FROM k GROUP BY vec_id HAVING count(DISTINCT ch) <> 8
    UNION ALL SELECT 'empty_channel', ch::INT::VARCHAR FROM k GROUP BY ch HAVING NOT bool_or(split = 'train' AND ok AND time_ok)""",
)
def channel_normalizer_findings(spark, d):
    """Some signals without their last channel, and channel 5 without a valid cell."""
    c = cells(spark, d).where("not (vec_id % 11 = 0 and channel = 7)").withColumn("channel_ok", F.col("channel_ok") & (F.col("channel") != 5))
    return G.normalizer_findings(c)


@query("channel_normalizer_apply", ("cells",), f"WITH {_STATS} SELECT vec_id, channel::INT AS channel, t::INT AS t, round((value - mean) / scale, 6) AS value FROM cells JOIN stats USING (channel)")
def channel_normalizer_apply(spark, d):
    c = cells(spark, d)
    return rounded(G.apply_normalizer(c, G.fit_normalizer(c)), "vec_id", "channel", "t")


@query("robust_channel_scale", ("cells",), "WITH s AS (SELECT vec_id, channel, quantile_disc(value, 0.5) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS q FROM cells GROUP BY vec_id, channel) SELECT vec_id, channel::INT AS channel, t::INT AS t, round((value - m) / greatest(q, 1e-6), 6) AS value FROM cells JOIN s USING (vec_id, channel)")
def robust_channel_scale(spark, d):
    return rounded(G.robust_scale(cells(spark, d)), "vec_id", "channel", "t")


@query(
    "chunk_timeline",
    ("cells",),
    """WITH g AS (SELECT DISTINCT vec_id, channel, s.s AS start, k.k FROM cells, (SELECT unnest([0, 2, 4, 6]) AS s) s, (SELECT unnest(range(4)) AS k) k),
    c AS (SELECT g.vec_id, g.start, g.channel, g.k, coalesce(value, 0) AS value, coalesce(time_ok, false) AS ok FROM g LEFT JOIN cells ON cells.vec_id = g.vec_id AND cells.channel = g.channel AND cells.t = g.start + g.k)
    SELECT vec_id || ':chunk:' || start AS chunk_id, channel::INT AS channel, k::INT AS k, round(value, 6) AS value, ok FROM c WHERE (vec_id, start) IN (SELECT (vec_id, start) FROM c GROUP BY vec_id, start HAVING bool_or(ok))""",
)
def chunk_timeline(spark, d):
    c = G.chunk(cells(spark, d), 4, 2, 8)
    return c.select(F.concat(F.col("vec_id").cast("string"), F.lit(":chunk:"), F.col("start").cast("string")).alias("chunk_id"), "channel", "k", F.round("value", 6).alias("value"), "ok")


@query(
    "chunk_fixed",
    (),
    "WITH s AS (SELECT vec_id, len(embedding) AS n, unnest(CASE WHEN len(embedding) < 15 THEN [0] ELSE range(0, len(embedding) - 15 + 4 + CASE WHEN (len(embedding) - 15) % 4 = 0 THEN 0 ELSE 1 END, 4) END) AS start, embedding FROM embeddings) SELECT vec_id, start::INT AS start, round(list_sum(embedding[start + 1:start + 15]::DOUBLE[]), 5) AS total FROM s WHERE start < n",
)
def chunk_fixed(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    e = e.select("vec_id", "v", F.explode(G.fixed_starts(F.size("v"), 15, 4, False)).alias("start"))
    total = F.aggregate(F.slice("v", F.col("start") + 1, F.lit(15)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", "start", F.round(total, 5).alias("total"))


@query("patch_signal", (), "SELECT vec_id, i::INT AS patch, round(list_sum(embedding[i * 7 + 1:i * 7 + 7]::DOUBLE[]), 5) AS total FROM (SELECT *, unnest(range(10)) AS i FROM embeddings)")
def patch_signal(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(G.patches(F.col("embedding").cast("array<double>"), 7)).alias("patch", "p"))
    return e.select("vec_id", "patch", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("pad_batch", (), "WITH r AS (SELECT vec_id, vec_id // 16 AS batch, 64 - vec_id % 5 AS n FROM embeddings) SELECT vec_id, batch, (max(n) OVER (PARTITION BY batch))::INT AS padded, n::INT AS valid FROM r")
def pad_batch(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), F.expr("slice(cast(embedding as array<double>), 1, cast(64 - vec_id % 5 as int))").alias("v"))
    p = G.pad_batch(e, "batch", "v")
    return p.select("vec_id", "batch", F.size("padded").alias("padded"), F.size(F.filter("mask", lambda x: x)).alias("valid"))


@query(
    "augment_mask",
    ("cells",),
    f"""WITH u AS (SELECT *, {_U('aug', 'vec_id', 't')} AS ut, {_U('aug-c', 'vec_id', 'channel')} AS uc FROM cells), l AS (SELECT *, min(uc) FILTER (channel_ok) OVER (PARTITION BY vec_id) AS lo FROM u)
    SELECT vec_id, channel::INT AS channel, t::INT AS t, channel_ok AND (uc >= 0.3 OR uc = lo) AS channel_ok, time_ok AND ut >= 0.2 AS time_ok FROM l""",
)
def augment_mask(spark, d):
    return G.mask_augment(cells(spark, d), 0.2, 0.3).select("vec_id", "channel", "t", "channel_ok", "time_ok")


@query("augment_noise", ("cells",), f"SELECT vec_id, channel::INT AS channel, t::INT AS t, round(CASE WHEN {_OK} THEN value + 0.1 * {_N('noise', 'vec_id', 'channel', 't')} ELSE value END, 5) AS value FROM cells")
def augment_noise(spark, d):
    return G.noise_augment(cells(spark, d), 0.1).select("vec_id", "channel", "t", F.round("value", 5).alias("value"))


@query(
    "augment_shift",
    ("cells",),
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY vec_id, channel ORDER BY t) - 1 AS r, count(*) OVER (PARTITION BY vec_id, channel) AS n FROM cells WHERE time_ok),
    m AS (SELECT vec_id, channel, ((r + (floor({_U('shift', 'vec_id')} * 5) - 2)::INT) % n + n) % n AS r, value FROM c)
    SELECT c.vec_id, c.channel::INT AS channel, c.t::INT AS t, round(m.value, 6) AS value FROM c JOIN m ON c.vec_id = m.vec_id AND c.channel = m.channel AND c.r = m.r""",
)
def augment_shift(spark, d):
    return rounded(G.shift_augment(cells(spark, d), 2), "vec_id", "channel", "t")


_PERM = """a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r FROM (SELECT DISTINCT vec_id FROM cells)),
 b AS (SELECT vec_id AS source, row_number() OVER (ORDER BY sha256(concat_ws(':', 'ctl', vec_id::VARCHAR)), vec_id) AS r FROM (SELECT DISTINCT vec_id FROM cells)),
 p AS (SELECT id AS vec_id, source FROM a JOIN b USING (r))"""
_CTL = {
    "zero": "SELECT vec_id, channel, t, 0.0::DOUBLE AS value FROM cells",
    "noise": f"SELECT vec_id, channel, t, m + s * {_N('ctl', 'vec_id', 'channel', 't')} AS value FROM cells, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM cells WHERE {_OK})",
    "mask": "SELECT vec_id, channel, t, time_ok::INT::DOUBLE AS value FROM cells",
    "length": "SELECT vec_id, channel, t, (t < count(*) FILTER (time_ok) OVER (PARTITION BY vec_id, channel))::INT::DOUBLE AS value FROM cells",
    "shuffled": "SELECT cells.vec_id, cells.channel, cells.t, o.value FROM cells JOIN p USING (vec_id) JOIN cells o ON o.vec_id = p.source AND o.channel = cells.channel AND o.t = cells.t",
}
_SUR = """SELECT vec_id, channel, t, value FROM (SELECT vec_id, channel, t, row_number() OVER (ORDER BY sha256(concat_ws(':', 'sur', vec_id::VARCHAR, channel::VARCHAR, t::VARCHAR)), vec_id, channel, t) AS r FROM cells)
 JOIN (SELECT value, row_number() OVER (ORDER BY sha256(concat_ws(':', 'sur-v', vec_id::VARCHAR, channel::VARCHAR, t::VARCHAR)), vec_id, channel, t) AS r FROM cells) USING (r)"""
_EIGHT = {"full": "SELECT vec_id, channel, t, value FROM cells", **_CTL, "timing": "SELECT vec_id, channel, t, (t = vec_id % 8)::INT::DOUBLE AS value FROM cells", "surrogate": _SUR}
_ROUND = "SELECT vec_id, channel::INT AS channel, t::INT AS t, round(value, 5) AS value FROM ({})"


def _control(name: str, key: str) -> None:
    @query(key, ("cells",), (f"WITH {_PERM} " if name == "shuffled" else "") + _ROUND.format(_CTL[name]))
    def run(spark, d):
        return G.control(cells(spark, d), name).select("vec_id", "channel", "t", F.round("value", 5).alias("value"))


for _name, _key in (("zero", "control_zero"), ("noise", "control_noise"), ("mask", "control_mask_only"), ("length", "control_length_only"), ("shuffled", "control_shuffle")):
    _control(_name, _key)


@query("control_suite", ("cells",), f"WITH {_PERM} " + " UNION ALL ".join(f"SELECT '{n}' AS control, vec_id, channel::INT AS channel, t::INT AS t, round(value, 5) AS value FROM ({s})" for n, s in _EIGHT.items()))
def control_suite(spark, d):
    """All eight conditions; a signal's event for the timing condition is at its time step vec_id modulo 8."""
    c = cells(spark, d)
    frames = G.timing_only(c.select("vec_id", F.pmod("vec_id", F.lit(8)).alias("frame")), "vec_id", 8)
    timing = c.select("vec_id", "channel", "t").join(frames.select("vec_id", F.col("frame").cast("int").alias("t"), "value"), ["vec_id", "t"])
    parts = {"full": c, **{n: G.control(c, n) for n in _CTL}, "timing": timing, "surrogate": G.surrogate(c)}
    out = None
    for n, part in parts.items():
        part = part.select(F.lit(n).alias("control"), "vec_id", "channel", "t", F.round("value", 5).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "control_surrogate",
    ("cells",),
    """WITH a AS (SELECT vec_id, channel, t, row_number() OVER (ORDER BY sha256(concat_ws(':', 'sur', vec_id::VARCHAR, channel::VARCHAR, t::VARCHAR)), vec_id, channel, t) AS r FROM cells),
    b AS (SELECT value, row_number() OVER (ORDER BY sha256(concat_ws(':', 'sur-v', vec_id::VARCHAR, channel::VARCHAR, t::VARCHAR)), vec_id, channel, t) AS r FROM cells)
    SELECT vec_id, channel::INT AS channel, t::INT AS t, round(value, 6) AS value FROM a JOIN b USING (r)""",
)
def control_surrogate(spark, d):
    return rounded(G.surrogate(cells(spark, d)), "vec_id", "channel", "t")


@query(
    "occlude",
    ("cells",),
    """SELECT vec_id, v AS variant, channel::INT AS channel, t::INT AS t, round(CASE WHEN hit THEN 0 ELSE value END, 6) AS value, NOT hit AS visible FROM
    (SELECT *, CASE v WHEN 'channels' THEN channel IN (0, 3) WHEN 'time' THEN t >= 2 AND t < 5 ELSE channel = 1 AND t >= 0 AND t < 4 END AS hit FROM cells, (VALUES ('channels'), ('time'), ('both')) x(v))""",
)
def occlude(spark, d):
    v = spark.createDataFrame([("channels", [0, 3], None, None), ("time", None, 2, 5), ("both", [1], 0, 4)], "variant string, channels array<int>, t0 int, t1 int")
    return G.occlude(cells(spark, d), v).select("vec_id", "variant", "channel", "t", F.round("value", 6).alias("value"), "visible")


_SENSORS = "sensors AS (SELECT label AS layout_id, vec_id AS name, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, vec_id % 7 <> 0 AS ok FROM embeddings)"
_W = "w AS (SELECT layout_id, a, b, e / sum(e) OVER (PARTITION BY layout_id, a) AS w FROM (SELECT p.layout_id, p.name AS a, q.name AS b, exp(-((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS e FROM sensors p JOIN sensors q ON p.layout_id = q.layout_id AND (p.ok AND q.ok OR NOT p.ok AND p.name = q.name)))"


def sensors(spark, d):
    v = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(F.col("label").alias("layout_id"), F.col("vec_id").alias("name"), v(0).alias("x"), v(1).alias("y"), v(2).alias("z"), (F.col("vec_id") % 7 != 0).alias("ok"))


@query("sensor_graph_weights", (), f"WITH {_SENSORS}, {_W} SELECT a, b, round(w, 6) AS w FROM w")
def sensor_graph_weights(spark, d):
    return G.graph_weights(sensors(spark, d), digits=6).select("a", "b", "w")


@query("masked_neighbor_mean", (), f"WITH {_SENSORS}, {_W} SELECT s.name, round(CASE WHEN s.ok THEN m.m ELSE 0 END, 6)::DOUBLE AS value FROM sensors s LEFT JOIN (SELECT a, sum(w * n.x) AS m FROM w JOIN sensors n ON n.name = w.b WHERE n.ok GROUP BY a) m ON m.a = s.name")
def masked_neighbor_mean(spark, d):
    return G.graph_mean(sensors(spark, d).withColumn("value", F.col("x"))).select("name", F.round("value", 6).alias("value"))


@query("mask_positions", ("cells",), f"WITH c AS (SELECT vec_id, t, count(*) OVER (PARTITION BY vec_id) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY {_U('mask', 'vec_id', 't')}, t) AS r FROM (SELECT DISTINCT vec_id, t FROM cells WHERE time_ok)) SELECT vec_id, t::INT AS t FROM c WHERE r <= least(n, greatest(1, ceil(n * 0.3)))")
def mask_positions(spark, d):
    return G.mask_positions(cells(spark, d), 0.3, 1)


@query("channel_geometry_check", (), f"WITH {_SENSORS} SELECT layout_id, count(*) AS sensors, count(DISTINCT name) = count(*) AS unique_names, bool_and(NOT ok OR (isfinite(x) AND isfinite(y) AND isfinite(z))) AS finite FROM sensors GROUP BY layout_id")
def channel_geometry_check(spark, d):
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull()
    s = sensors(spark, d).withColumn("fine", ~F.col("ok") | ~(bad("x") | bad("y") | bad("z")))
    return s.groupBy("layout_id").agg(F.count("*").alias("sensors"), (F.count_distinct("name") == F.count("*")).alias("unique_names"), F.bool_and("fine").alias("finite"))


@query("sensor_tensorize", (), f"WITH {_SENSORS}, m AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM sensors GROUP BY layout_id)) SELECT layout_id, count(*)::INT AS n, any_value(m)::INT AS width, md5(string_agg(name::VARCHAR, ',' ORDER BY name)) AS names, round(sum(x), 5) AS x_total FROM sensors, m GROUP BY layout_id")
def sensor_tensorize(spark, d):
    from evidara.operators.checks import tensorize

    t = tensorize(sensors(spark, d))
    return t.select("layout_id", "n", F.size("x").alias("width"), F.md5(F.array_join(F.transform("names", lambda x: x.cast("string")), ",")).alias("names"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("x_total"))


@query("montage_select", (), "SELECT vec_id, round(embedding[5], 6)::DOUBLE AS first, round(embedding[2], 6)::DOUBLE AS second, CASE WHEN vec_id % 9 = 0 THEN 'zz' ELSE '' END AS missing FROM embeddings")
def montage_select(spark, d):
    from evidara.operators.checks import montage_select as pick

    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("c"), i.cast("string"))).alias("names"), F.col("embedding").alias("values"))
    e = e.withColumn("montage", F.when(F.col("vec_id") % 9 == 0, F.array(F.lit("c4"), F.lit("c1"), F.lit("zz"))).otherwise(F.array(F.lit("c4"), F.lit("c1"))))
    p = pick(e)
    r = lambda i: F.round(F.get("picked", F.lit(i)).cast("double"), 6)
    return p.select("vec_id", r(0).alias("first"), r(1).alias("second"), F.array_join("missing", ",").alias("missing"))


@query("synthetic_signals", (), "SELECT c_custkey AS subject, step::INT AS step, round(((42 + 17 * c_custkey + 3 * step) % 23) / 23, 6) AS a, round(((42 + 17 * c_custkey + 5 * step + 11) % 29) / 29, 6) AS b FROM (SELECT c_custkey, unnest(range(100)) AS step FROM customer)")
def synthetic_signals(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("step"))
    base = F.lit(42) + 17 * F.col("subject")
    return s.select("subject", "step", F.round((base + 3 * F.col("step")) % 23 / 23, 6).alias("a"), F.round((base + 5 * F.col("step") + 11) % 29 / 29, 6).alias("b"))


@query(
    "numeric_parity",
    ("cells",),
    """WITH p AS (SELECT vec_id, value AS a, value + CASE WHEN vec_id % 4 = 0 THEN 0.01 ELSE 1e-9 END AS b FROM cells)
    SELECT vec_id, round(max(abs(a - b)), 6) AS max_abs, round(avg(abs(a - b)), 6) AS mean_abs, max(abs(a - b)) <= 1e-6 OR max(abs(a - b) / greatest(abs(a), 1e-12)) <= 1e-6 AS passed FROM p GROUP BY vec_id""",
)
def numeric_parity(spark, d):
    from evidara.operators.checks import numeric_parity as parity

    c = cells(spark, d)
    got = c.select("vec_id", "channel", "t", (F.col("value") + F.when(F.col("vec_id") % 4 == 0, 0.01).otherwise(1e-9)).alias("value"))
    return parity(c.select("vec_id", "channel", "t", "value"), got).select("vec_id", F.round("max_abs", 6).alias("max_abs"), F.round("mean_abs", 6).alias("mean_abs"), "passed")


@query("ctc_collapse", ("cells",), """WITH b AS (SELECT vec_id, t, arg_max(channel, (value, -channel)) AS k FROM cells WHERE time_ok GROUP BY vec_id, t), l AS (SELECT *, lag(k, 1, 0) OVER (PARTITION BY vec_id ORDER BY t) AS p FROM b)
    SELECT vec_id, coalesce(string_agg(k::VARCHAR, ' ' ORDER BY t) FILTER (k <> 0 AND k <> p), '') AS tokens FROM l GROUP BY vec_id""")
def ctc_collapse(spark, d):
    from evidara.operators.checks import ctc_collapse as collapse

    t = collapse(cells(spark, d).where("time_ok").select("vec_id", "t", F.col("channel").alias("token"), F.col("value").alias("score")), blank=0)
    return t.select("vec_id", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))
