"""A toxicity classifier, regularised by counterfactuals.

Features are a text's distinct words and their prefixes. Those that training texts with the label
show far more often than others (lower confidence bound of their precision) become the vocabulary,
and a logistic model is fitted to them. For a training text with identity terms a counterfactual
copy has each term swapped for another of its set; the squared change of the score is penalised, so
that naming a group doesn't move the score.

Identity terms are those of a list and those found in the labelled texts: words that neutral texts
mention too, but that texts with the label hold more often than others do. Each is swapped for the word
of most like context (the frequent words beside it) that isn't tied to the label, so prefixes that a
neutral term shares with abuse can't carry a score by themselves.

Near copies of one training text count once there: texts that share a band of min-hashes are compared,
and only those whose word sets are as good as equal (Jaccard similarity of 0.8 or more, by a sketch) are one.

The fit takes at most ``max_rows`` labelled rows of each label, those of least hash; every text is
scored whole. Edge cases: null and empty texts get the model's bias; labels that are null or without
a document are ignored, and of a doc_id's labels the greatest counts; rows that repeat a doc_id are
scored by their own text; without both labels every score is the smoothed share of label 1; an empty
table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, materialize, ship

#: Interchangeable terms, a parameter of the operator: one set a line.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino"],
    ["immigrants", "foreigners", "refugees", "locals"],
    ["young", "old", "elderly"],
    ["disabled", "deaf", "blind"],
    ["femmes", "hommes"],
    ["frauen", "männer"],
    ["mujeres", "hombres"],
]
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def features_of(word: str):
    yield "=" + word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n]


def _words(raw: bytes) -> set[str]:
    return set(_WORD.findall(raw.decode("utf-8", "replace").lower()))


def _swapped(words: set[str], terms: dict[str, str]) -> set[str] | None:
    return {terms.get(w, w) for w in words} if any(w in terms for w in words) else None


def _count(batches):
    import pyarrow as pa

    seen = {0: Counter(), 1: Counter()}

    def out():
        keys = list(seen[0] | seen[1])
        rows = [pa.array(keys, pa.string())] + [pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0)]
        for y in (0, 1):
            seen[y].clear()
        return pa.RecordBatch.from_arrays(rows, names=["feature", "pos", "neg"])

    for b in batches:
        for raw, y in zip(b.column("body").to_pylist(), b.column("y").to_pylist()):
            seen[y].update({f for w in _words(raw) for f in features_of(w)})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield out()
    yield out()


SKETCH, BANDS, BAND = 64, 6, 3


def _sketches(batches):
    """Of each text the ``SKETCH`` least hashes of its distinct words, and its bands of min-hashes."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    mix = np.random.default_rng(11).integers(1, 1 << 63, BANDS * BAND, dtype=np.uint64) | np.uint64(1)
    for b in batches:
        least, bands = [], []
        for raw in b.column("body").to_pylist():
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in set(raw.split())), np.uint64)
            least.append(np.sort(h)[:SKETCH].view(np.int64))
            m = (h[:, None] * mix[None]).min(0) if len(h) else np.zeros(len(mix), np.uint64)
            bands.append([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in m.reshape(BANDS, BAND)])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(least, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "y", "least", "bands"])


def likeness(a: list, b: list) -> float:
    """Jaccard similarity of two word sets by their least hashes (unsigned order), exact if both are small."""
    both = sorted({x % (1 << 64) for x in a} | {x % (1 << 64) for x in b})[:SKETCH]
    return len({x % (1 << 64) for x in a} & {x % (1 << 64) for x in b} & set(both)) / len(both) if both else 1.0


def near_copies(rows: list, alike: float = 0.8) -> set:
    """Ids of (doc_id, y, least, bands), at most 2 * max_rows of them, that repeat one of smaller id and equal label."""
    seen: dict = {}
    gone = set()
    for doc, y, least, bands in sorted(rows, key=lambda r: (r[1], r[0])):
        rivals = {tuple(x) for k in enumerate(bands) for x in seen.get((y, *k), ())}
        if any(likeness(least, x) >= alike for x in rivals):
            gone.add((doc, y))
            continue
        for k in enumerate(bands):
            seen.setdefault((y, *k), set()).add(tuple(least))
    return gone


def _mentions(batches):
    """Words with how many texts of each label hold them, and the words beside them with counts."""
    import pyarrow as pa

    seen = {0: Counter(), 1: Counter()}
    beside: Counter = Counter()

    def out():
        keys = list(seen[0] | seen[1])
        rows = [(k, None, seen[1][k], seen[0][k]) for k in keys] + [(a, b, n, 0) for (a, b), n in beside.items()]
        for c in (*seen.values(), beside):
            c.clear()
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["word", "beside", "pos", "neg"])

    for b in batches:
        for raw, y in zip(b.column("body").to_pylist(), b.column("y").to_pylist()):
            words = _WORD.findall(raw.decode("utf-8", "replace").lower())
            seen[y].update(set(words))
            beside.update(zip(words, words[1:]))
            beside.update(zip(words[1:], words))
            if len(beside) + len(seen[0]) + len(seen[1]) > 300_000:
                yield out()
    yield out()


def found_terms(texts: DataFrame, share: float, least: int = 2, most: int = 500, frequent: int = 200) -> dict[str, str]:
    """Identity terms of labelled texts (body, y), each with the word it is swapped for.

    A term is in ``least`` texts of either label or more, in texts with label 1 more often than those make up,
    and not so surely that it names the label itself. At most ``most`` terms, and four times as many words that
    may stand in for them; contexts are told by the ``frequent`` most frequent words.
    """
    import numpy as np

    got = materialize(texts.mapInArrow(_mentions, "word string, beside string, pos long, neg long").groupBy("word", "beside").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "mentions")
    words = got.where("beside is null").select("word", "pos", "neg")
    both = words.where((F.col("pos") >= least) & (F.col("neg") >= least))
    tied = F.col("pos") / (F.col("pos") + F.col("neg"))
    sure = _bound(F.col("pos"), F.col("neg")) > max(0.5, 2 * share if share < 0.4 else 0.8)
    order = lambda df, n: [r.word for r in df.orderBy(F.desc(F.col("pos") + F.col("neg")), "word").limit(n).collect()]
    terms = order(both.where((tied > min(1.5 * share, (1 + share) / 2)) & ~sure), most)
    others = order(both.where(tied <= min(1.2 * share, 0.5)), 4 * most)
    marks = {w: i for i, w in enumerate(order(words, frequent))}
    if not terms or not others:
        return {}
    known = terms + others
    spark = texts.sparkSession
    small = spark.createDataFrame([(w, i) for i, w in enumerate(known)], "word string, i int")  # at most 5 * most
    near = spark.createDataFrame(list(marks.items()), "beside string, j int")
    x = np.zeros((len(known), len(marks)))
    for i, j, n in got.where("beside is not null").join(F.broadcast(small), "word").join(F.broadcast(near), "beside").select("i", "j", "pos").collect():
        x[i, j] = n
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    like = x[: len(terms)] @ x[len(terms) :].T
    return {w: others[int(k)] for w, k in zip(terms, like.argmax(1))}


def _bound(pos, neg, z: float = 1.96):
    """Lower confidence bound of the share of pos."""
    n = pos + neg
    p = pos / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _indices(words, vocab, cache):
    out = set()
    for w in words:
        got = cache.get(w)
        if got is None:
            got = tuple(vocab[f] for f in features_of(w) if f in vocab)
            if len(cache) > 200_000:
                cache.clear()
            cache[w] = got
        if got:
            out.update(got)
    return sorted(out)


def fit_logistic(rows, swaps, y, weight, n: int, penalty: float, l2: float = 1e-6, steps: int = 800, rate: float = 0.1):
    """Non-negative weights and a bias. rows, swaps: feature indices of texts, and (text, its copy's indices)."""
    import numpy as np

    def flat(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter((i for x in lists for i in x), np.int64)

    r, i = flat(rows)
    own = np.array([k for k, _ in swaps], np.int64)
    sr, si = flat([x for _, x in swaps]) if swaps else (np.empty(0, np.int64), np.empty(0, np.int64))
    w, b = np.zeros(n), -1.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[i], len(rows)) + b, -30, 30)))
        g = weight * (p - y) / total
        if swaps:
            q = 1 / (1 + np.exp(-np.clip(np.bincount(sr, w[si], len(swaps)) + b, -30, 30)))
            d = 2 * penalty * (p[own] - q) / len(swaps)
            np.add.at(g, own, d * p[own] * (1 - p[own]))
            h = -d * q * (1 - q)
        grad = np.append(np.bincount(i, g[r], n) + (np.bincount(si, h[sr], n) if swaps else 0) + l2 * w, g.sum() + (h.sum() if swaps else 0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:n], 0), b - step[n]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, vocabulary: int = 3_000, penalty: float = 10.0, terms=IDENTITY_TERMS, tied: float = 1.5, report: dict | None = None):
    """(vocabulary: feature -> index, weights, bias) from labels (doc_id, y in 0 and 1).

    A feature enters the vocabulary when the lower bound of its precision is ``tied`` times the share of label 1.
    report: gets the numbers of training rows, near copies, identity terms and rows with a counterfactual
    copy, and the mean change of the score from a text to its copy.
    """
    import numpy as np

    report = {} if report is None else report
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("y in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("y").cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * max_rows
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).join(F.broadcast(ids), "doc_id"), "labelled")
    sketches = [(r.doc_id, r.y, list(r.least), list(r.bands)) for r in texts.mapInArrow(_sketches, "doc_id long, y int, least array<long>, bands array<long>").collect()]  # at most 2 * max_rows
    gone = near_copies(sketches)
    report.update(rows=len(sketches), near_copies=len(gone))
    if gone:
        texts = texts.join(F.broadcast(spark.createDataFrame(sorted(gone), "doc_id long, y int")), ["doc_id", "y"], "left_anti")
    counts = texts.mapInArrow(_count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    bound, floor = _bound(F.col("pos"), F.col("neg")), min(tied * share, (1 + share) / 2)
    top = counts.where("pos >= 3").withColumn("bound", bound).where(F.col("bound") > floor).orderBy(F.desc("bound"), F.desc("pos"), "feature").limit(vocabulary).collect()
    vocab = {r.feature: k for k, r in enumerate(top)}
    base = float(np.log(share / (1 - share)))
    if not vocab:
        return vocab, np.zeros(0), base
    swap = found_terms(texts, share) | {t: s[(k + 1) % len(s)] for s in terms for k, t in enumerate(s)}
    held = spark.sparkContext.broadcast((vocab, swap))

    def rows(batches):
        import pyarrow as pa

        cache: dict = {}
        vocab, swap = held.value
        for b in batches:
            own, swapped = [], []
            for x in b.column("body").to_pylist():
                words = _words(x)
                other = _swapped(words, swap)
                own.append(_indices(words, vocab, cache))
                swapped.append(None if other is None else _indices(other, vocab, cache))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], names=["y", "own", "swapped"])

    got = texts.mapInArrow(rows, "y int, own array<int>, swapped array<int>").collect()  # at most 2 * max_rows short rows
    got.sort(key=lambda r: (r.y, r.own, r.swapped or []))
    y = np.array([r.y for r in got], float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    swaps = [(k, r.swapped) for k, r in enumerate(got) if r.swapped is not None]
    w, b = fit_logistic([r.own for r in got], swaps, y, weight, len(vocab), penalty)
    p = lambda f: 1 / (1 + np.exp(-np.clip(b + sum(w[i] for i in f), -30, 30)))
    moved = [(k, x) for k, x in swaps if x != got[k].own]
    report.update(terms=len(swap), swapped=len(swaps), moved=len(moved), change=float(np.mean([abs(p(got[k].own) - p(x)) for k, x in moved])) if moved else 0.0)
    return vocab, w, b


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score for every row."""
    import numpy as np

    ship(docs.sparkSession)
    vocab, w, b = model
    held = docs.sparkSession.sparkContext.broadcast((vocab, w.tolist(), b))

    def run(batches):
        import pyarrow as pa

        vocab, w, b0 = held.value
        cache: dict = {}
        for b in batches:
            z = np.array([b0 + sum(w[i] for i in _indices(_words(x), vocab, cache)) for x in b.column("body").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, **how) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels (doc_id, y) outside of the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    model = fit(docs, labels.where(fold != held_out), **how)
    return score(docs, model).select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
