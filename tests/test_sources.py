"""Files: manifests, submissions, volumes, caches, and the stream of queries."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbalest.functions import text
from arbalest.sources import cache, manifests, nifti, slabs, submissions
from arbalest.streaming import incremental


def test_registry(spark, tmp_path):
    for split, n in (("val", 2), ("test", 3)):
        d = tmp_path / "deep" / "dataset1"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{split}_queries.csv").write_text("\n".join([",".join(manifests.QUERIES), *(f"q{i},a/q{i}.nii.gz,T1,x" for i in range(n))]))
        (d / f"{split}_gallery.csv").write_text("\n".join([",".join(manifests.GALLERY), *(f"t{i},a/t{i}.nii.gz,T2,x" for i in range(n))]))
    root = manifests.find_root(str(tmp_path))
    assert root == str(tmp_path / "deep")
    queries, gallery = manifests.registry(spark, root, [("dataset1", "val"), ("dataset1", "test")])
    assert queries.count() == gallery.count() == 5 and {r.dataset for r in queries.collect()} == {"dataset1"}
    (tmp_path / "deep/dataset1/val_gallery.csv").write_text("\n".join([",".join(manifests.GALLERY), *(f"t{i},a,T2,x" for i in range(5))]))
    assert manifests.registry(spark, root, [("dataset1", "val")])[1].count() == 5
    (tmp_path / "deep/dataset1/val_gallery.csv").write_text(",".join(manifests.GALLERY))
    with pytest.raises(ValueError, match="one side"):
        manifests.registry(spark, root, [("dataset1", "val")])
    labels = spark.createDataFrame([("qx", "tx")], "query_id string, target_id string")
    with pytest.raises(ValueError, match="no training pairs"):
        manifests.training_pairs(labels.limit(0).withColumns({"query_image": F.lit(""), "target_image": F.lit("")}), labels, queries, gallery)
    assert manifests.first_source([queries.limit(0), gallery]) is gallery
    with pytest.raises(ValueError, match="no file"):
        manifests.repaired(queries, "/x/", ".nii", "query_id", spark.createDataFrame([("/x/q0.nii",)], "path string"))


def test_submission_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "t2 t1"), ("q2", "t1 t2")], "query_id string, target_id_ranking string")
    submissions.write(rows, str(tmp_path / "sub"), 1)
    assert sorted(map(tuple, submissions.read(spark, str(tmp_path / "sub")).collect())) == [("q1", "t2 t1"), ("q2", "t1 t2")]
    file = tmp_path / "best.csv"
    file.write_bytes(b"content")
    want = hashlib.sha256(b"content").hexdigest()
    assert submissions.restore(spark, str(file), str(tmp_path / "out" / "copy.csv"), want) and not submissions.restore(spark, str(file), str(tmp_path / "no.csv"), "0" * 64)
    assert (tmp_path / "out/copy.csv").read_bytes() == b"content" and not (tmp_path / "no.csv").exists()


def test_volumes(spark, tmp_path):
    data = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    data[0, 0, 0], data[1, 2, 3] = np.nan, np.inf
    affine = np.array([[2.0, 0, 0, -5], [0, 3, 0, 1], [0, 0, 4, 2], [0, 0, 0, 1]])
    raw = nifti.encode(data, affine)
    (tmp_path / "a.nii").write_bytes(raw)
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "c.txt").write_text("no volume")
    want = np.nan_to_num(data, nan=0, posinf=0)
    got = nifti.read_volumes(spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(r["shape"] == [2, 3, 4] and np.allclose(np.reshape(r.data, (2, 3, 4)), want) for r in got)
    heads = nifti.read_headers(spark, str(tmp_path)).collect()
    assert all(np.allclose(np.reshape(r.affine, (4, 4)), affine) and np.allclose(r.zooms, [2, 3, 4]) and r.sform_code == 1 for r in heads)
    assert nifti.listing(spark, str(tmp_path)).count() == 2
    extended = bytearray(raw[:352]) + (16).to_bytes(4, "little") + bytes(12) + raw[352:]
    extended[348] = 1
    extended[108:112] = np.float32(368).tobytes()
    assert nifti.head_of(gzip.compress(bytes(extended))) == nifti.head_of(bytes(extended)) == bytes(extended[:368])
    assert nifti.header(nifti.head_of(bytes(extended)))["n_extensions"] == 1
    rows = spark.createDataFrame([(f"v{i}", [2, 3, 4], [float(i)] * 24, affine.ravel().tolist()) for i in range(5)], "name string, shape array<int>, data array<double>, affine array<double>")
    nifti.write_volumes(rows, str(tmp_path / "out"))
    assert {r.path.rsplit("/", 1)[1]: r.data[7] for r in nifti.read_volumes(spark, str(tmp_path / "out")).collect()} == {f"v{i}.nii.gz": float(i) for i in range(5)}


def volume_rows(spark, n, edge=4, bad=None):
    rows = [(f"v{i}", [edge] * 3 if i != bad else [7, 7, 7], [float(i)] * edge**3, np.eye(4).ravel().tolist(), "more") for i in range(n)]
    return spark.createDataFrame(rows, "name string, shape array<int>, data array<float>, affine array<double>, `a.b` string").repartition(4)


def test_headers_are_read_by_range(spark, tmp_path):
    random = np.random.default_rng(1)
    for edge in (4, 64):
        raw = nifti.encode(random.normal(size=(edge,) * 3).astype(np.float32), np.eye(4))
        long = bytearray(raw[:352]) + (3008).to_bytes(4, "little") + random.bytes(3004) + raw[352:]  # a long extension
        long[348] = 1
        long[108:112] = np.float32(3360).tobytes()
        for name, content in (("plain", raw), ("long", bytes(long))):
            (tmp_path / f"{name}{edge}.nii").write_bytes(content)
            (tmp_path / "deep").mkdir(exist_ok=True)
            (tmp_path / f"deep/{name}{edge}.nii.gz").write_bytes(gzip.compress(content))
    got = {r.path.rsplit("/", 1)[1]: r for r in nifti.read_headers(spark, str(tmp_path)).collect()}
    whole = {r.path.rsplit("/", 1)[1]: r for r in nifti.read_headers(spark, f"file:{tmp_path}", ranged=False).collect()}
    assert len(got) == 8 and got.keys() == whole.keys()
    for name, r in got.items():
        assert r.asDict() | {"path": 0, "bytes_read": 0} == whole[name].asDict() | {"path": 0, "bytes_read": 0}
        assert r.bytes_read <= (8192 if "long" in name else 2048) and whole[name].bytes_read >= (900_000 if "64" in name else 300)
    assert {got[f"{n}{e}.nii"].bytes_read for n in ("plain",) for e in (4, 64)} == {352} and got["long4.nii"].n_extensions == 1
    assert nifti.read_headers(spark, str(tmp_path / "plain4.nii")).count() == 1
    (tmp_path / "none").mkdir()
    assert nifti.read_headers(spark, f"file://{tmp_path}/none").collect() == []
    from arbalest.sources import volume_source

    volume_source.register(spark)
    assert spark.read.format("nifti").option("files", 3).load(str(tmp_path)).rdd.getNumPartitions() == 3


def test_volumes_are_committed_whole_or_not_at_all(spark, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(Exception, match="reshape"):
        nifti.write_volumes(volume_rows(spark, 12, bad=7), str(out))
    assert not list(out.rglob("*.nii*")) and not (out / "_temporary").exists()
    nifti.write_volumes(volume_rows(spark, 12), str(out))
    nifti.write_volumes(volume_rows(spark, 3, 2), str(out))  # replaces files of the same name
    sizes = {r.path.rsplit("/", 1)[1]: r["shape"] for r in nifti.read_volumes(spark, str(out)).collect()}
    assert len(sizes) == 12 and sizes["v1.nii.gz"] == [2, 2, 2] and sizes["v9.nii.gz"] == [4, 4, 4] and not (out / "_temporary").exists()
    nifti.write_volumes(volume_rows(spark, 2), f"file://{out}", packed=False, mode="overwrite")
    assert sorted(f.name for f in out.iterdir() if not f.name.startswith(".")) == ["v0.nii", "v1.nii"]
    nifti.write_volumes(volume_rows(spark, 2).where("false"), str(out))
    with pytest.raises(Exception, match="file name"):
        nifti.write_volumes(volume_rows(spark, 1).withColumn("name", F.lit("../x")), str(out))


def test_four_dimensions_and_scaling():
    raw = bytearray(nifti.encode(np.zeros((2, 2, 2), np.float32), np.eye(4)))
    import struct

    struct.pack_into("<8h", raw, 40, 4, 2, 2, 2, 2, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, 4, 16)
    struct.pack_into("<2f", raw, 112, 2.0, 1.0)
    raw = bytes(raw[:352]) + np.arange(16, dtype="<i2").tobytes()
    assert np.allclose(nifti.volume(raw), np.arange(8).reshape((2, 2, 2), order="F") * 2 + 1)


def test_cache_computes_only_what_is_missing(spark, tmp_path):
    asked = []

    def compute(rows):
        asked.append(sorted(r.fingerprint for r in rows.collect()))
        return rows.select("fingerprint", F.length("fingerprint").alias("n"))

    rows = lambda *f: spark.createDataFrame([(x,) for x in f], "fingerprint string")
    path = str(tmp_path / "features")
    assert cache.cached(rows("a", "bb"), path, "g64", compute).count() == 2
    assert {r.n for r in cache.cached(rows("bb", "ccc"), path, "g64", compute).collect()} == {2, 3}
    cache.cached(rows("a"), path, "g96", compute)
    assert asked == [["a", "bb"], ["ccc"], ["a"]]


def test_a_full_cache_is_not_written_again(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "fingerprint string")
    compute = lambda r: r.select("fingerprint", F.length("fingerprint").alias("n"))
    first = cache.cached(rows, str(tmp_path), "s", compute)
    before = sorted(str(p) for p in tmp_path.rglob("*"))
    again = cache.cached(rows.limit(1), str(tmp_path), "s", compute)
    assert sorted(str(p) for p in tmp_path.rglob("*")) == before and (first.count(), again.count()) == (2, 1)


def test_prefixes_are_kept_by_plan_files_and_settings(spark, tmp_path):
    data, kept = str(tmp_path / "in"), tmp_path / "kept"
    spark.range(20).withColumn("v", F.col("id") * 2).write.parquet(data)
    plan = lambda n=3: spark.read.parquet(data).where(F.col("id") > n).select("id", (F.col("v") + 1).alias("w"))
    tables = lambda: sorted(p.name for p in kept.iterdir() if p.name[0] not in "._") if kept.exists() else []
    first = cache.cached_prefix(plan(), str(kept))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, plan().collect())) and first.columns == ["id", "w"] and len(tables()) == 1
    cache.cached_prefix(plan(), str(kept))
    assert len(tables()) == 1  # the same plan, made anew
    cache.cached_prefix(plan(4), str(kept))
    cache.cached_prefix(plan(), str(kept), "other settings")
    cache.cached_prefix(plan().withColumnRenamed("w", "u"), str(kept))
    assert len(tables()) == 4
    spark.range(5).withColumn("v", F.col("id")).write.mode("append").parquet(data)
    assert cache.cached_prefix(plan(), str(kept)).count() == plan().count() and len(tables()) == 5
    with pytest.raises(ValueError, match="deterministic"):
        cache.cached_prefix(plan().withColumn("r", F.rand()), str(kept))


def test_a_slice_reads_its_slabs_alone(spark, tmp_path):
    random = np.random.default_rng(2)
    whole = {f"v{i:02d}": random.normal(size=(5, 3, 4 + i % 9)).astype(np.float32) for i in range(40)}
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in whole.items()] + [("none", [0, 2, 3], [])]
    path = str(tmp_path / "slabs")
    slabs.write(spark.createDataFrame(rows, "id string, shape array<int>, data array<double>").repartition(3), path, 2, 10)
    n_slabs = spark.read.parquet(path).count()
    for z in (0, 3, 11, 99, -4):
        got = slabs.axial_slice(spark, path, z)
        assert len(got.collect()) == 40
        for r in got.collect():
            v = whole[r.id]
            at = min(max(z, 0), v.shape[2] - 1)
            assert r.z == at and np.array_equal(np.float32(r.data), v[:, :, at].ravel())
    got = slabs.axial_slice(spark, path, 0)
    got.collect()
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    scan = scan.executedPlan().collectLeaves().head() if "Adaptive" in scan.getClass().getName() else scan
    assert "PushedFilters" in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert scan.metrics().apply("numOutputRows").value() < n_slabs / 2


def test_header_text_and_names(spark):
    row = spark.createDataFrame([(bytearray(b" caf\xe9 \0junk"), "a/b:c", "x" * 20)], "raw binary, path string, long string").select(
        text.header_text(F.col("raw")).alias("t"), text.safe_id(F.col("path")).alias("s"), text.short_id(F.col("long")).alias("l")
    ).first()
    assert (row.t, row.s, row.l) == ("café", "a_b_c", "x" * 13 + "…")


def test_stream_equals_batch(spark, tmp_path):
    schema = "dataset string, split string, query_id string, qv array<double>"
    gallery = spark.createDataFrame([("d", "val", f"t{i}", [float(i), 1.0]) for i in range(5)], "dataset string, split string, target_id string, tv array<double>")
    for i in range(3):
        spark.createDataFrame([("d", "val", f"q{i}", [1.0, float(i)])], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    incremental.rank_stream(stream, gallery, 2, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and {r.target_id for r in got.where("rank = 1").collect()} == {"t4"}
