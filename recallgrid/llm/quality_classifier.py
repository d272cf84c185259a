"""A quality classifier from positive and unlabelled texts.

Trusted positives are labelled texts of good quality, unlabelled ones any texts. The class prior is
the least ratio of the two sets' upper tails under a first classifier (best-bin estimate), and a
small network is then fitted to the non-negative unbiased risk: prior * R_p+ + max(0, R_u- - prior *
R_p-). Features are shares of character classes, word shapes, repetition and length, so texts of
any language and any words are scored alike.

The fit takes at most ``max_rows`` rows of either set, those of least hash; every text is scored
whole. Edge cases: null and empty texts have features of their own (all zero) and a score; without
positives every score is the prior 0.5; an empty table gives an empty result; extra columns are
ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, materialize, ship

N_FEATURES = 24


def _classes():
    import numpy as np

    t = np.full(256, 9, np.uint8)  # other ASCII
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[97:123] = 1
    t[65:91] = 2
    t[48:58] = 3
    t[[ord(c) for c in ".,;:?'\"()-"]] = 4
    t[ord("!")] = 5
    t[ord("|")] = 6
    t[[ord(c) for c in "#*$%&<>@~^_=+/\\"]] = 7
    t[128:] = 8
    t[10] = 10
    return t


_TABLE = None


def text_features(raw: bytes) -> list[float]:
    import numpy as np

    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    a = np.frombuffer(raw, np.uint8)
    share = np.bincount(_TABLE[a], minlength=11) / len(a)
    size = np.fromiter(map(len, words), np.int64, n)
    distinct = len(set(words))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    marks = sum(raw.count(x) for x in (b"!!", b"|", b"##", b"**", b"$$", b"%%", b"&&")) / n
    h = np.fromiter(map(hash, words), np.int64, n)
    again = 0.0
    if n > 3:
        tri = h[:-2] * 31 + h[1:-1] * 1009 + h[2:]
        again = 1 - len(np.unique(tri)) / len(tri)
    return [
        1.0, float(np.log1p(n)) / 10, *share[1:9].tolist(), float(share[0] + share[10]), float(size.mean()) / 20, float(size.std()) / 20, float((size == 1).mean()), float((size <= 3).mean()), distinct / n,
        distinct / n**0.5 / 50, len(filled) / n, 1 - len(set(filled)) / max(len(filled), 1), min(marks, 3.0), again, float(size.max() > 60), float(np.log1p(len(raw) / n)), float(share[2] / (share[1] + share[2] + 1e-9)),
    ]


def _features(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        x = np.array([text_features(r) for r in b.column("body").to_pylist()], np.float32).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], names=[b.schema.names[0], "x"])


def _net(params, x):
    import numpy as np

    a, c, u, d = params
    h = np.tanh(x @ a + c)
    return h, h @ u + d


def train(xp, xu, prior: float | None, hidden: int = 16, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 0):
    """Parameters that minimise the non-negative risk, or with prior None tell the two sets apart."""
    import numpy as np

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (xp.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0]
    m, v = [0.0] * 4, [0.0] * 4
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        (hp, zp), (hu, zu) = _net(params, xp), _net(params, xu)
        neg, unl = np.logaddexp(0, zp), np.logaddexp(0, zu)  # losses as 0
        dp, du = np.zeros(len(zp)), np.zeros(len(zu))
        if prior is None:
            dp, du = -(1 - sig(zp)) / len(zp), sig(zu) / len(zu)
        elif unl.mean() - prior * neg.mean() >= 0:
            dp = prior * (-(1 - sig(zp)) - sig(zp)) / len(zp)
            du = sig(zu) / len(zu)
        else:  # the bounded part is below zero: step back up on it alone
            dp, du = prior * sig(zp) / len(zp), -sig(zu) / len(zu)
        grads = [0.0] * 4
        for x, h, d in ((xp, hp, dp), (xu, hu, du)):
            back = np.outer(d, params[2]) * (1 - h * h)
            for k, g in enumerate((x.T @ back, back.sum(0), h.T @ d, d.sum())):
                grads[k] = grads[k] + g
        for k in range(4):
            g = grads[k] + decay * params[k] * (k in (0, 2))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return params


def class_prior(xp, xu) -> float:
    """Share of positives among the unlabelled: the least tail ratio, on the halves that a first classifier hasn't seen."""
    import numpy as np

    first = train(xp[::2], xu[::2], None, steps=300)
    sp, su = (np.sort(_net(first, x[1::2])[1]) for x in (xp, xu))
    cut = np.quantile(sp, np.linspace(0, 0.9, 91))
    qp, qu = (1 - np.searchsorted(s, cut) / len(s) for s in (sp, su))
    slack = np.sqrt(np.log(400) / (2 * len(su))) + np.sqrt(np.log(400) / (2 * len(sp)))
    return float(np.clip(((qu + slack / 2) / np.maximum(qp, 1e-9)).min(), 0.05, 0.97))


def fit(docs: DataFrame, positives: DataFrame, max_rows: int = 20_000):
    """(means, deviations, parameters, prior) from the ids of trusted positives."""
    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    least = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = least(positives).withColumn("s", F.lit(1)).unionByName(least(docs).withColumn("s", F.lit(0)))  # at most 2 * max_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).join(F.broadcast(ids), "doc_id").select(F.struct("s", "doc_id").alias("k"), "body")
    got = rows.mapInArrow(_features, "k struct<s:int,doc_id:long>, x array<float>").toPandas()
    got = got.assign(s=[k["s"] for k in got.k], i=[k["doc_id"] for k in got.k]).sort_values(["s", "i"])
    xs = [np.array(got.x[got.s == s].tolist(), float).reshape(-1, N_FEATURES) for s in (1, 0)]
    if not len(xs[0]) or not len(xs[1]):
        return None
    rng = np.random.default_rng(1)
    xp, xu = (x[rng.permutation(len(x))] for x in xs)
    mean, sd = xu.mean(0), xu.std(0) + 1e-3
    xp, xu = (np.clip((x - mean) / sd, -8, 8) for x in (xp, xu))
    prior = class_prior(xp, xu) if min(len(xp), len(xu)) >= 40 else 0.5
    return mean, sd, train(xp, xu, prior), prior


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score for every row."""
    import numpy as np

    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = held.value
        for b in batches:
            x = np.array([text_features(r) for r in b.column("body").to_pylist()], float).reshape(-1, N_FEATURES)
            z = np.zeros(len(x)) if model is None else _net(model[2], np.clip((x - model[0]) / model[1], -8, 8))[1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted; the positives are labels (doc_id, y) with y = 1 outside of the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = fit(docs, labels.where((fold != held_out) & (F.col("y") == 1)).select("doc_id").distinct(), **how)
    return score(docs, model).select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
