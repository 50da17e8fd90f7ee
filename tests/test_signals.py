"""Missing-value rules of tracers, labels and grids."""

import math

import pytest
from pyspark.sql import functions as F

from tensorloom.functions.tracer import aligned, stars, tracer, valid_label
from tensorloom.operators.region import region_summary, tracer_table
from tensorloom.sources import nifti
from tensorloom.streaming.tracer_stream import write_tracer

NAN = float("nan")


def values(spark, rows, kind):
    df = spark.createDataFrame(rows, "b double, p double")
    return [r[0] for r in df.select(tracer(F.col("b"), F.col("p"), kind)).collect()]


def test_t1map(spark):
    got = values(spark, [(2.0, 4.0), (0.0, 1.0), (1.0, 0.0), (1e-7, 1.0), (NAN, 1.0), (None, 1.0)], "T1map")
    assert got == [-0.25, None, None, None, None, None]


def test_t1w(spark):
    got = values(spark, [(2.0, 4.0), (0.0, 1.0), (1.0, 0.0), (-1e-7, 1.0), (1.0, NAN)], "T1w")
    assert got == [2.0, None, 0.0, None, None]


def test_signal_type_is_checked():
    with pytest.raises(ValueError):
        tracer(F.lit(1.0), F.lit(1.0), "T2")


def test_labels_round_half_even_after_aggregation(spark):
    df = spark.createDataFrame([("a", 1.9999, 1.0), ("a", 2.0001, 3.0), ("a", 2.5, 5.0), ("a", 0.0, 9.0), ("a", -1.0, 9.0), ("a", NAN, 9.0), ("a", 4.0, NAN)], "s string, label double, value double")
    got = sorted((r["labels"], r["values"]) for r in region_summary(df, ["s"]).where("values IS NOT NULL").collect())
    assert got == [(2.0, 1.0), (2.0, 3.0), (2.0, 5.0)]
    assert region_summary(df, ["s"]).where("values IS NULL").count() == 1
    assert not spark.range(1).select(valid_label(F.lit(NAN))).first()[0]


def test_reducers(spark):
    df = spark.createDataFrame([("a", 1.0, float(v)) for v in (1, 2, 10)] + [("a", 1.0, NAN)], "s string, label double, value double")
    one = lambda f: region_summary(df, ["s"], func=f).first()["values"]
    assert one("median") == 2.0 and one("mean") == pytest.approx(13 / 3) and one("count") == 3.0
    assert one(lambda x: float(x.max() - x.min())) == 9.0
    with pytest.raises(ValueError):
        one("mode")


def test_grid(spark):
    row = lambda b: spark.createDataFrame([([1.0, 100.0], b)], "a array<double>, b array<double>").select(aligned(F.col("a"), F.col("b"))).first()[0]
    assert row([1.0, 100.0009]) and not row([1.0, 100.002]) and not row([1.0]) and not row([1.0, None])


def test_stars(spark):
    rows = [(v,) for v in (1e-4, 1e-3, 0.01, 0.05, 0.06)] + [(None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p double").select(stars(F.col("p"))).collect()]
    assert got == ["****", "***", "**", "*", "ns", None]


def test_images_to_long_table(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    base, post = rng.uniform(1, 2, (3, 4, 5)), rng.uniform(1, 2, (3, 4, 5))
    base[0, 0, 0] = 0.0
    mask = (rng.uniform(size=base.shape) > 0.3).astype(float)
    seg = np.where(rng.uniform(size=base.shape) > 0.5, 1.0, 2.0)
    seg[0, 1] = 0.0
    paths = {}
    for name, values in (("base", base), ("post", post), ("mask", mask), ("seg", seg)):
        paths[name] = f"{tmp_path}/{name}.nii.gz"
        with open(paths[name], "wb") as f:
            f.write(nifti.build(values, np.diag([2.0, 2.0, 2.0, 1.0])))
    images = nifti.read_images(spark, list(paths.values())).withColumn("volume_id", F.regexp_replace("volume_id", "^file:", ""))
    schema = "subject string, time_point int, baseline_path string, post_injection_path string, signal_type string, mask_path string, segmentation_path string"
    jobs = spark.createDataFrame([("s", 1, paths["base"], paths["post"], "T1w", paths["mask"], paths["seg"]), ("t", 2, paths["base"], paths["post"], "T1map", paths["mask"], None)], schema)
    got = tracer_table(jobs, images).toPandas()
    files = tracer_table(jobs).toPandas()
    order = ["subject", "labels", "values"]
    assert np.allclose(got.sort_values(order)[["labels", "values"]], files.sort_values(order)[["labels", "values"]], equal_nan=True) and len(got) == len(files)
    for label in (1.0, 2.0):
        inside = (mask > 0) & (seg == label) & (base > 1e-6)
        want = np.median(post[inside] / base[inside])
        assert got[(got.subject == "s") & (got.labels == label)]["values"].item() == pytest.approx(want)
    free = got[got.subject == "t"]
    assert len(free) == int((mask > 0).sum()) and free.labels.isna().all()
    nifti.register(spark)
    assert spark.read.format("volume").option("paths", paths["base"]).load().agg(F.sum("value")).first()[0] == pytest.approx(base.sum())


def images_of(spark, tmp_path, **arrays):
    """A manifest of one job and its images, written plain or (names in .gz) gzipped."""
    import numpy as np

    paths = {}
    for name, (values, grid, packed) in arrays.items():
        paths[name] = f"{tmp_path}/{name}.nii" + (".gz" if packed else "")
        with open(paths[name], "wb") as f:
            f.write(nifti.build(np.asarray(values, float), grid, packed))
    row = ("s", 1, paths["base"], paths["post"], "T1w", paths["mask"], paths.get("seg"))
    return spark.createDataFrame([row], "subject string, time_point int, baseline_path string, post_injection_path string, signal_type string, mask_path string, segmentation_path string").withColumn("ord", F.lit(0))


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("slabs", [1, 3, 20])
def test_slabs_give_every_voxel_of_the_mask_once(spark, tmp_path, monkeypatch, packed, slabs):
    import numpy as np

    from tensorloom.sources import aligned

    rng = np.random.default_rng(slabs)
    grid, shape = np.diag([2.0, 1.0, 1.0, 1.0]), (3, 4, 7)
    base, post, mask = rng.random(shape), rng.random(shape), rng.choice([0.0, 1.0, float("nan"), -1.0], shape)
    job = images_of(spark, tmp_path, base=(base, grid, False), post=(post, grid, packed), mask=(mask, grid, False))
    rows = aligned.read_aligned(job, slabs)
    got = {(r["i"], r["j"], r["k"]): (r["baseline"], r["post_injection"], r["mask"], r["segmentation"]) for r in rows.collect()}
    assert rows.count() == len(got) and got == {tuple(map(int, at)): (base[tuple(at)], post[tuple(at)], 1.0, None) for at in np.argwhere(mask > 0)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_mask_is_applied_in_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan

    from tensorloom.sources.aligned import AlignedReader

    reader = AlignedReader([{"ord": 0, "subject": "a"}, {"ord": 1, "subject": "b"}], 2)
    left = list(reader.pushFilters([GreaterThan(("mask",), 0.0), EqualTo(("subject",), "b"), LessThan(("i",), 3), IsNotNull(("mask",))]))
    assert [type(f) for f in left] == [LessThan] and reader.above == 0.0 and [(p.job["ord"], p.slab) for p in reader.partitions()] == [(1, 0), (1, 1)]


def test_images_that_dont_fit_are_refused(spark, tmp_path):
    import gzip
    import struct

    import numpy as np

    grid, ones = np.eye(4), np.ones((2, 2, 2))
    whole = (ones, grid, False)
    other = np.ones((4, 4, 4))
    for bad, what in (((other, grid, False), "different shapes"), ((ones, np.diag([1.0, 1.0, 2.0, 1.0]), False), "one grid")):
        for name in ("post", "mask", "seg"):
            job = images_of(spark, tmp_path, **({"base": whole, "post": whole, "mask": whole, "seg": whole} | {name: bad}))
            images = nifti.read_images(spark, f"{tmp_path}/*.nii").withColumn("volume_id", F.regexp_replace("volume_id", "^file:", ""))
            for held in (None, images):
                with pytest.raises(Exception, match=what):
                    tracer_table(job, held).collect()
    job = images_of(spark, tmp_path, base=whole, post=whole, mask=whole, seg=whole)
    with pytest.raises(Exception, match="no segmentation image"):
        tracer_table(job, nifti.read_images(spark, [f"{tmp_path}/{n}.nii" for n in ("base", "post", "mask")]).withColumn("volume_id", F.regexp_replace("volume_id", "^file:", ""))).collect()
    with pytest.raises(Exception, match="unknown signal_type"):
        tracer_table(job.withColumn("signal_type", F.lit("T2"))).collect()
    raw = bytearray(nifti.build(np.ones((2, 2, 4)), grid, False))
    struct.pack_into("<8h", raw, 40, 4, 2, 2, 2, 2, 1, 1, 1)
    for content in (bytes(raw), gzip.compress(bytes(raw))):
        with pytest.raises(ValueError, match="several frames"):
            nifti.voxel_batch("x", content)


def test_states_merge_in_any_parts(spark):
    import numpy as np

    from tensorloom.operators.region import Moments

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(1e3, 1, 500), rng.gamma(1.0, 5.0, 700)])
    for order in (3, 4):
        m = Moments(order)
        want = ((x - x.mean()) ** order).mean() / x.std() ** order
        states = [m.update(m.init(), part) for part in np.split(x, [1, 7, 300, 650])]
        for chosen in (states, states[::-1], [*states[2:], m.init(), *states[:2]]):
            total = m.init()
            for s in chosen:
                total = m.merge(total, s)
            assert m.finish(total) == pytest.approx(want)
    rows = [(None if k % 7 == 0 else f"s{k % 3}", float(k % 4), NAN if k % 5 == 0 else float(v)) for k, v in enumerate(x)] + [("empty", 1.0, NAN), ("one", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "s string, label double, value double").repartition(5)
    got = {(r["s"], r["labels"]): r["values"] for r in region_summary(df, ["s"], func=Moments(3)).collect()}
    want = {}
    for s, label, value in rows:
        if label > 0:
            want.setdefault((s, label), []).append(value)
    assert set(got) == set(want) and got["empty", 1.0] is None and got["one", 1.0] is None
    for key, values in want.items():
        held = np.array([v for v in values if v == v])
        if len(held) > 1:
            assert got[key] == pytest.approx(((held - held.mean()) ** 3).mean() / held.std() ** 3)
    medians = {(r["s"], r["labels"]): r["values"] for r in region_summary(df, ["s"]).collect()}
    assert set(medians) == set(want) and all(medians[k] == (pytest.approx(np.nanmedian(v)) if np.isfinite(v).any() else None) for k, v in want.items())
    plan = region_summary(df, ["s"], func=Moments(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange") < plan.index("MapInArrow")


def test_nifti_headers():
    import gzip
    import struct

    import numpy as np

    grid = np.array([[0, -2.0, 0, 5], [2.0, 0, 0, 6], [0, 0, 3.0, 7], [0, 0, 0, 1]])
    values, affine = nifti.parse(nifti.build(np.arange(24.0).reshape(2, 3, 4), grid))
    assert (values == np.arange(24.0).reshape(2, 3, 4)).all() and np.allclose(affine, grid)
    raw = bytearray(gzip.decompress(nifti.build(np.ones((2, 2, 2)), grid)))
    struct.pack_into("<2f", raw, 112, 3.0, 1.0)
    struct.pack_into("<2h", raw, 252, 1, 0)
    struct.pack_into("<6f", raw, 256, 0, 0, math.sqrt(0.5), 5, 6, 7)
    struct.pack_into("<8f", raw, 76, 1, 2, 2, 3, 1, 1, 1, 1)
    values, affine = nifti.parse(bytes(raw))
    assert (values == 4.0).all() and np.allclose(affine, grid, atol=1e-6)
    with pytest.raises(ValueError):
        nifti.parse(b"x" * 400)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 2.0), (4.0, 1.0)], "b double, p double")
    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        write_tracer(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/ck", "b", "p", "T1w")
    assert sorted(r["values"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0.25, 2.0]
