"""Sources and sinks through real files."""

import json
import pathlib

from pyspark.sql import functions as F

from evidara.sources import files as S


def test_manifest_round_trip(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    rows = [{"sample_id": "a", "dataset_id": "d", "target": {"text": "x"}}, {"sample_id": "a", "dataset_id": "d"}]
    p.write_text(json.dumps({"kind": "manifest", "dataset_id": "d"}) + "\n\n" + "\n".join(map(json.dumps, rows)) + "\n[1]\n")
    s = S.read_manifest(spark, str(p)).collect()
    assert [r["sample_id"] for r in s] == ["a", "a"] and s[0]["target"]["language"] == "en" and s[0]["task"] == "unknown"
    assert sorted(r["code"] for r in S.manifest_findings(spark, str(p)).collect()) == ["duplicate_sample", "not_an_object"]


def test_signals(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.json").write_text("[[1, 2], [3, 4]]")
    (root / "b.json").write_text("[[1, 2], [3]]")
    want = spark.createDataFrame([("1", "a.json", None, 2), ("2", "b.json", None, 2), ("3", "c.json", None, 2), ("4", "../a.json", None, 2), ("5", "a.json", "0" * 64, 2)], "sample_id string, uri string, checksum_sha256 string, channel_count int")
    good, bad = S.read_signals(spark, want, str(root))
    assert [r["sample_id"] for r in good.collect()] == ["1"]
    assert {r["sample_id"]: r["code"] for r in bad.collect()} == {"2": "not_rectangular", "3": "missing_file", "4": "bad_path", "5": "checksum_mismatch"}
    mapping = spark.createDataFrame([("1", "train", "a.json", None)], "sample_id string, split string, uri string, checksum_sha256 string")
    samples = spark.createDataFrame([("1", 2), ("9", 2)], "sample_id string, channel_count int")
    good, bad = S.read_authorized_features(spark, samples, mapping, str(root))
    assert good.count() == 1 and [r["code"] for r in bad.collect()] == ["unmapped"]


def test_signals_of_many_samples_in_one_file(spark, tmp_path):
    lines = [{"key": "a", "values": [[1, 2], [3, 4]]}, {"key": "b", "values": [[1, 2], [3]]}, {"key": "twice", "values": [[1], [2]]}, {"key": "twice", "values": [[1], [2]]}]
    (tmp_path / "many.json").write_text("\n".join(map(json.dumps, lines)) + "\n")
    (tmp_path / "one.json").write_text("[[5, 6], [7, 8]]")
    rows = [("1", "many.json", "a", None, 2), ("2", "many.json", "b", None, 2), ("3", "many.json", "none", None, 2), ("4", "many.json", "a", "0" * 64, 2), ("5", "many.json", "twice", None, 2), ("6", "one.json", None, None, 2), ("7", "other.json", "a", None, 2)]
    want = spark.createDataFrame(rows, "sample_id string, uri string, array_key string, checksum_sha256 string, channel_count int")
    good, bad = S.read_signals(spark, want, str(tmp_path))
    assert {r["sample_id"]: r["values"] for r in good.collect()} == {"1": [[1, 2], [3, 4]], "6": [[5, 6], [7, 8]]}
    assert {r["sample_id"]: r["code"] for r in bad.collect()} == {"2": "not_rectangular", "3": "missing_array", "4": "checksum_mismatch", "5": "repeated_array", "7": "missing_file"}
    samples = spark.createDataFrame([("1", 2), ("6", 2), ("9", 2)], "sample_id string, channel_count int")
    good, bad = S.read_authorized_features(spark, samples, want.where("sample_id in ('1', '6')").withColumn("split", F.lit("train")), str(tmp_path))
    assert good.count() == 2 and [r["code"] for r in bad.collect()] == ["unmapped"]


def test_signal_files_do_not_grow_one_by_one_with_the_samples(spark, tmp_path):
    from evidara.queries import flows

    e = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i + F.col("id")).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    root, s = flows.signal_files(spark, str(tmp_path))
    assert s.count() == 3000 and len(list(pathlib.Path(root.removeprefix("file:")).rglob("part-*.txt"))) == 3


def test_checksums(spark):
    e = spark.createDataFrame([("a.json", "x"), ("b.txt", "0" * 64), ("c.json", "0" * 64)], "uri string, expected string")
    f = spark.createDataFrame([("a.json", bytearray(b"1")), ("b.txt", bytearray(b"1")), ("d.json", bytearray(b"1"))], "uri string, content binary")
    assert {r[0]: r[1] for r in S.checksum_findings(e, f).collect()} == {"a.json": "malformed_checksum", "b.txt": "wrong_extension", "c.json": "missing", "d.json": "unexpected"}


def test_adapter_as_a_data_source(spark):
    from evidara.sources import adapters

    d = adapters.read(spark, adapters.SyntheticAdapter, subjects=5, partitions=3, trials=2, steps=4)
    rows = {r["sample_id"]: r for r in d.collect()}
    assert sorted(rows) == [f"s{s}-t{t}" for s in range(5) for t in range(2)] and d.rdd.getNumPartitions() == 3
    assert rows["s2-t1"]["values"] == [[(42 + 34 + 1 + 3 * t) % 23 / 23 for t in range(4)], [(42 + 34 + 1 + 5 * t + 11) % 29 / 29 for t in range(4)]]


def test_inventory(spark):
    rows = [("p1", "a", "v1", "1"), ("p2", "a", "v1", "1"), ("p3", "b", "v1", "1"), ("p4", "a", "v2", "2"), ("p5", "b", "v1", "")]
    got = {tuple(r) for r in S.inventory_findings(spark.createDataFrame(rows, "path string, task string, version string, subject string")).collect()}
    assert got == {("unparsable_subject", "p5"), ("duplicate_subject", "a/v1/1"), ("several_versions", "a"), ("partial_task_set", "2")}


def test_every_line_of_a_manifest(spark, tmp_path):
    """Broken objects, rows without an id and rows of a wrong type are findings; no line vanishes."""
    a, b, none = tmp_path / "a.jsonl", tmp_path / "b.jsonl", tmp_path / "none.jsonl"
    a.write_text('\n{"kind": "manifest"}\n{"sample_id": "a"}\n{"sample_id": "b", "interval": "soon"}\n{"sample_id": "c"\n{"text": "x"}\n{"sample_id": " "}\n"text"\n{"kind": "list"}\n \t \n{"sample_id": "e"} tail\n')
    b.write_text('{"sample_id": "d", "dataset_id": "x"}\n{"kind": "manifest"}\n')
    none.write_text('{"sample_id": "f"}\n')
    both = [str(a), str(b)]
    codes = sorted(r["code"] for r in S.manifest_findings(spark, both).collect())
    assert codes == sorted(["wrong_type", "invalid_json", "invalid_json", "missing_sample_id", "missing_sample_id", "not_an_object", "unknown_kind", "header_not_first", "several_datasets"])
    assert sorted(r["sample_id"] for r in S.read_manifest(spark, both).collect()) == ["a", "d"]
    lines = [x for f in (a, b) for x in f.read_text().splitlines() if x.strip()]
    assert len(lines) == 2 + 2 + len(codes) - 2  # headers, samples, findings of a line
    assert [r["code"] for r in S.manifest_findings(spark, str(none)).collect()] == ["missing_header"]


def test_tree_digest(spark):
    from pyspark.sql import functions as F

    rows = [(f"k{i % 2}", f"v{i}") for i in range(500)] + [("k0", "again")] * 300
    d = spark.createDataFrame(rows, "k string, v string")
    digest = lambda df, leaf: {r["k"]: (r["n"], r["digest"]) for r in S.tree_digest(df, F.col("v"), "k", leaf).collect()}
    one = digest(d, 4)
    assert one == digest(d.repartition(7), 4) and one["k0"][0] == 550 and one["k1"][0] == 250
    less = spark.createDataFrame(rows[:-1], d.schema)
    assert digest(less, 4)["k0"] != one["k0"] and digest(less, 4)["k1"] == one["k1"]
    other = d.withColumn("v", F.when(F.col("v") == "v7", "v8").otherwise(F.col("v")))
    assert digest(other, 4)["k1"] != one["k1"] and digest(other, 4)["k0"] == one["k0"]
    assert digest(d.where("false"), 4) == {}


def test_adapter_reads_the_subjects_that_are_asked_for(spark, tmp_path):
    from evidara.sources import adapters

    class Counted(adapters.SyntheticAdapter):
        @classmethod
        def name(cls):
            return "counted_signals"

        def samples(self, subject):
            (tmp_path / f"read-{subject}").touch()
            yield from super().samples(subject)

    some = adapters.read(spark, Counted, ["s3", "s17", "nobody"], subjects=40, partitions=8, trials=2, steps=4)
    assert sorted(r["sample_id"] for r in some.where("start_s > 0").collect()) == ["s17-t1", "s3-t1"]
    assert sorted(f.name for f in tmp_path.iterdir()) == ["read-17", "read-3"]
    assert some.count() == 4 and adapters.read(spark, Counted, [], subjects=40).count() == 0 and adapters.read(spark, Counted, subjects=40).count() == 80
