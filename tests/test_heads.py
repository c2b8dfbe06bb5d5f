"""The wide ridge head against numpy."""

import numpy as np
import pytest

from tidemark.operators import heads
from tidemark.plans import research

SF = "/root/testdata/sf0.01"


def softmax(s, t):
    e = np.exp((s - s.max(1, keepdims=True)) / t)
    return e / e.sum(1, keepdims=True)


def plain_head(x, y, penalty, classes):
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, target = (x - mean) / scale, np.eye(classes)[y]
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (target - target.mean(0)))
    return lambda other: (other - mean) / scale @ w + target.mean(0)


def plain(parts, classes):
    (xt, yt), (xv, yv), (xs, _) = parts
    tried = []
    for penalty in heads.PENALTIES:
        s = plain_head(xt, yt, penalty, classes)(xv)
        tried += [(np.mean(-np.log(softmax(s, t)[np.arange(len(yv)), yv])), -penalty, t) for t in heads.TEMPERATURES]
    loss, penalty, t = min(tried)
    return loss, -penalty, t, softmax(plain_head(np.concatenate([xt, xv]), np.concatenate([yt, yv]), -penalty, classes)(xs), t)


@pytest.mark.parametrize("block", [256, 7])
def test_head_equals_numpy_on_embeddings(spark, block):
    rows = research._parts(spark, SF)
    pdf = rows.orderBy("vec_id").toPandas()
    part = lambda k: (np.stack(pdf[pdf.part == k].embedding).astype(float), pdf[pdf.part == k].label.to_numpy())
    loss, penalty, t, p = plain([part(k) for k in ("train", "validation", "test")], 3)
    head = heads.fit_head(rows.repartition(5), "embedding", "label", "part", 3, 64, block=block)
    assert (head.penalty, head.temperature) == (penalty, t) and abs(head.validation_loss - loss) < 1e-9
    got = heads.predict_head(rows.where("part = 'test'"), "embedding", head, 64).orderBy("vec_id").toPandas()
    assert np.allclose(np.stack(got.probabilities), p, atol=1e-8) and (got.predicted.to_numpy() == p.argmax(1)).all()
    (r,) = research.ridge_head_report(spark, SF).collect()
    y = part("test")[1]
    assert (r.penalty, r.temperature, r.n) == (penalty, t, len(y)) and abs(r.accuracy - np.mean(p.argmax(1) == y)) < 1e-12
    assert abs(r.log_loss - np.mean(-np.log(p[np.arange(len(y)), y]))) < 1e-8 and abs(r.brier - np.mean(((p - np.eye(3)[y]) ** 2).sum(1))) < 1e-8
    assert r.majority_accuracy == max(np.bincount(y)) / len(y) and list(r.predicted_counts) == np.bincount(p.argmax(1), minlength=3).tolist()


def test_thousand_columns_of_which_one_tells(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(240, 600)), rng.integers(0, 4, 240)
    x[:, 17] = y + rng.normal(scale=0.1, size=240)
    x[:, 18] = 5.0
    rows = [(i, x[i].tolist(), int(y[i]), "train" if i < 120 else "validation" if i < 180 else "test") for i in range(240)] + [(900, None, 1, "train"), (901, [1.0], 1, "train"), (902, x[0].tolist(), 9, "train"), (903, [None] * 600, 1, "validation")]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, part string").repartition(4)
    split = [(x[a:b], y[a:b]) for a, b in ((0, 120), (120, 180), (180, 240))]
    loss, penalty, t, p = plain(split, 4)
    head = heads.fit_head(df.where("id <> 903"), "v", "y", "part", 4, 600)
    assert (head.penalty, head.temperature) == (penalty, t) and abs(head.validation_loss - loss) < 1e-7
    got = heads.predict_head(df.where("part = 'test'"), "v", head, 600).orderBy("id").toPandas()
    assert np.allclose(np.stack(got.probabilities), p, atol=1e-6)


def test_parts_without_rows_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "train")], "id int, v array<double>, y int, part string")
    with pytest.raises(ValueError, match="training and validation"):
        heads.fit_head(df, "v", "y", "part", 2, 2)
