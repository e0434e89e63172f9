"""Quantiles, fences and one-to-one columns of unions of blocks against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablefit.functions.ranks import union_quantiles
from tablefit.operators import issues as I
from tablefit.operators.facts import Facts


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(9)
    n = 900
    pdf = pd.DataFrame({"id": np.arange(n)})
    pdf["x"] = rng.normal(size=n).round(3)
    pdf["hot"] = np.where(rng.random(n) < 0.6, 5.0, rng.integers(0, 9, n))
    pdf["tail"] = np.exp(rng.normal(size=n) * 2)
    pdf["same"] = 1.5
    pdf["sparse"] = np.where(np.arange(n) % 50 == 0, rng.normal(size=n), np.nan)
    pdf["y"] = rng.integers(0, 4, n).astype(str)
    pdf["copy"] = "c" + pdf["y"]
    pdf["nearly"] = np.where(pdf.index == 17, "c" + ((pdf["y"].astype(int) + 1) % 4).astype(str), pdf["copy"])  # one row breaks it
    pdf["none"] = None
    return pdf


@pytest.fixture(scope="module")
def placed(spark, frame):
    df = spark.createDataFrame(frame.astype({"none": object}), "id long, x double, hot double, tail double, same double, sparse double, y string, copy string, nearly string, none string")
    return Facts(df), Facts(df).df.withColumn("__b", I.block_of(["id"]))


@pytest.fixture(scope="module")
def samples(placed, frame):
    masks = I.subsample_masks(10)
    block = {r["id"]: r["__b"] for r in placed[1].select("id", "__b").collect()}
    b = frame["id"].map(block)
    return masks, [frame[[bool(m >> x & 1) for x in b]] for m in masks]


NUMBERS = ["x", "hot", "tail", "same", "sparse"]


def test_union_quantiles(placed, samples):
    masks, parts = samples
    unions = np.array([[m >> b & 1 for b in range(I.BLOCKS)] for m in masks])
    pairs = [x for i, n in enumerate(NUMBERS) for x in (F.lit(i), F.col(n))]
    rows = placed[1].select(F.col("__b").alias("b"), F.stack(F.lit(5), *pairs).alias("i", "v")).where("v is not null")
    for cuts, probs in ((63, [0.25, 0.75]), (3, [0.0, 0.1, 0.5, 1.0])):
        got = union_quantiles(rows, unions, probs, cuts=cuts, accuracy=50)
        for u, part in enumerate(parts):
            for i, n in enumerate(NUMBERS):
                for p in probs:
                    assert got[u, i, p] == pytest.approx(np.quantile(part[n].dropna(), p), rel=1e-12), (u, n, p)
    assert union_quantiles(rows.where("false"), unions, [0.5]) == {}


def test_outside_fences(placed, samples):
    masks, parts = samples
    got = I.outside_fences(placed[1], NUMBERS, masks)
    for u, part in enumerate(parts):
        for i, n in enumerate(NUMBERS):
            v = part[n].dropna()
            a, b = np.quantile(v, 0.25), np.quantile(v, 0.75)
            assert got.get((u, i), 0) == int(((v < a - 1.5 * (b - a)) | (v > b + 1.5 * (b - a))).sum())


def test_mapped_columns(placed, samples, frame):
    masks, parts = samples
    got = I.mapped_in_each(placed[0], placed[1], "y", masks)
    want = []
    for part in parts:
        k = 0
        for n in frame.columns.drop("y"):
            known = part[part[n].notna()]
            if len(known) and part[n].nunique() == part["y"].nunique() and known.groupby(n)["y"].nunique().max() == 1:
                k += 1
        want.append(k)
    assert got == want and {1, 2} == set(got)


def test_samples_of_a_small_table(placed):
    got = I.readiness_samples(placed[0].df, ["id"], "y", 5).collect()
    assert len(got) == 5 and all(10 <= r["readiness_score"] <= 100 for r in got)
