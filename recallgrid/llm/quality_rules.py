"""Quality rules: text statistics and an n-gram perplexity band.

The language model is a modified Kneser-Ney model of order four over a text's characters, its words in
their order with one boundary between them, one for each language group. Spark counts the n-grams of all
texts, those across boundaries too; the interpolated probabilities lie in arrays sorted by the n-gram's
64-bit key (four UTF-16 code units, so that characters beyond 16 bits are two symbols), one array for each
order, looked up by binary search; an n-gram that occurs once in the corpus is the scored text's own and
counts as unseen, so that noise isn't likely for having been counted. A text's perplexity is that of its words after one another, each scored by
an even mixture of its language's model and the model of all languages, so
that a quotation in another language isn't taken for noise; the fewer symbols a language has, the
less its own model weighs. Every language has a model. Each language group has, for each
doubling of the text's length, a lower and an upper bound on log-perplexity: the median, less or
plus a few robust standard deviations of that side. Texts outside of the band are rejected. A length
with few texts takes its band from the nearest lengths of its language, and a language with few
texts from a blend of its own texts and all languages' nearest lengths, so every text is judged.

Size of the model: all types of character n-grams, not of words or texts, without a cut-off; 16 bytes
for each type of the highest order in its language's model and as much in that of all languages.

Edge cases: null and empty texts have no words and fail the base rules; a null language is a group
of its own; equal texts of a language get equal verdicts; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, by_bytes, materialize, ship, trimmed, worker_state

ORDER = 4
_SYMBOLS = b"#*$%&|<>"


def text_stats(raw: bytes) -> tuple[list[bytes], int, int, int, int, int]:
    """The words, and their code points, the symbols, repeated lines, words in repeated 5-word windows, and code points beyond 16 bits."""
    import numpy as np

    words = raw.split()
    n = len(words)
    a = np.frombuffer(raw, np.uint8)
    if not n:
        return words, 0, 0, 0, 0, 0
    space = (a == 32) | ((a >= 9) & (a <= 13))
    chars = len(a) - int(space.sum()) - int(((a & 0xC0) == 0x80).sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    repeated = 0
    if n > 5:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        m = n - 4
        w = h[:m].copy()
        for i in range(1, 5):
            w *= np.uint64(0x9E3779B97F4A7C15)
            w ^= w >> np.uint64(29)
            w += h[i : i + m]
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(m, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    return words, chars, symbols, dup, repeated, int((a >= 0xF0).sum())


def word_parts(words: list[bytes]):
    """What each word (without white space, not empty) gives the stream of symbols.

    Keys of its inner n-grams, those that end at its third symbol or later, its closing boundary included;
    how many each word has; and the two symbols that the next word sees, and the two that the word before sees.
    """
    import numpy as np

    a = np.frombuffer(("\n" + b"\n\n".join(words).decode("utf-8", "replace") + "\n").encode("utf-16-le"), np.uint16).astype(np.uint64)
    edge = np.flatnonzero(a == 10)
    start, end = edge[0::2], edge[1::2]
    count = end - start - 2
    begin = np.cumsum(count) - count
    at = np.repeat(start - begin, count) + np.arange(int(count.sum()))
    key = (a[at] << np.uint64(48)) | (a[at + 1] << np.uint64(32)) | (a[at + 2] << np.uint64(16)) | a[at + 3]
    return key, count, (a[end - 2] << np.uint64(16)) | a[end - 1], (a[start + 1] << np.uint64(16)) | a[start + 2]


#: The two symbols before a text's first word's boundary.
OPENING = (10 << 16) | 10


def joint_grams(joint):
    """The two n-grams across a boundary, from the symbols before it (high half) and after it."""
    import numpy as np

    before, after = joint >> np.uint64(32), joint & np.uint64(0xFFFFFFFF)
    gap = np.uint64(10)
    first = (before << np.uint64(32)) | (gap << np.uint64(16)) | (after >> np.uint64(16))
    second = ((before & np.uint64(0xFFFF)) << np.uint64(48)) | (gap << np.uint64(32)) | after
    return first, second


def joints(tail, head, opens):
    """For each word of a row of texts what stands before and after its opening boundary; opens: places of first words."""
    import numpy as np

    before = np.empty_like(tail)
    before[1:] = tail[:-1]
    before[opens] = OPENING
    return (before << np.uint64(32)) | head


class Words:
    """The words seen by a task, numbered, with what each gives the stream."""

    def __init__(self):
        import numpy as np

        self.index, self.tail, self.head = {}, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def number(self, words):
        """The words' numbers, and the new words with their inner n-grams and counts of these."""
        import numpy as np

        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        key = count = None
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            key, count, tail, head = word_parts(new)
            self.tail, self.head = np.concatenate([self.tail, tail]), np.concatenate([self.head, head])
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words)), key, count


def fit_kneser_ney(key, count) -> tuple[list, float]:
    """From the counts of full n-grams: for each order its sorted keys, probabilities, and its contexts' back-off weights; and the floor.

    What occurs once in the whole corpus takes part in the estimates but isn't among the keys: the text that
    is scored is where it occurs, and left out of its own model it hasn't been seen.
    """
    import numpy as np

    mask = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]
    tables = []  # (keys, counts, occurrences) by order; below the highest the counts are of contexts an n-gram was seen in
    k, c = np.asarray(key, np.uint64), np.asarray(count, np.float64)
    o = np.argsort(k)
    k, c = k[o], c[o]
    tables.append((k, c, c))
    for n in range(ORDER - 1, 0, -1):
        above, _, raw = tables[-1]
        k, inv, c = np.unique(above & mask[n], return_inverse=True, return_counts=True)
        tables.append((k, c.astype(np.float64), np.bincount(inv, raw, len(k))))
    tables.reverse()
    out = []
    for n, (k, c, raw) in enumerate(tables, 1):
        n1, n2, n3, n4 = (max(int((c == i).sum()), 1) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = np.clip(np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), [0, 0.1, 0.1, 0.1], [0, 0.95, 1.9, 2.85])
        off = d[np.minimum(c, 3).astype(int)]
        ctx, inv = np.unique(k >> np.uint64(16), return_inverse=True)
        total = np.bincount(inv, c, len(ctx))
        left = np.bincount(inv, off, len(ctx)) / total  # the mass that goes to the lower order
        lower = np.full(len(k), 1.0 / (len(tables[0][0]) + 1)) if n == 1 else out[-1][1][np.searchsorted(out[-1][0], k & mask[n - 1])]
        p = (c - off) / total[inv] + left[inv] * lower
        out.append((k, p, ctx, left, raw > 1, np.bincount(inv, raw, len(ctx)) > 1))
    floor = -math.log(len(tables[0][0]) + 1)  # of symbols that no model has seen
    return [(k[again], np.log(p[again]), ctx[known], np.log(np.maximum(left[known], 1e-12))) for k, p, ctx, left, again, known in out], floor


def score_grams(model: tuple[list, float], key):
    """Natural log-probability of each full n-gram's last symbol."""
    import numpy as np

    uniq, inv = np.unique(key, return_inverse=True)
    lp, weight, todo = np.zeros(len(uniq)), np.zeros(len(uniq)), np.arange(len(uniq))
    tables, floor = model
    for n in range(ORDER, 0, -1):
        k, p, ctx, left = tables[n - 1]
        x = uniq[todo] & np.uint64((1 << (16 * n)) - 1)
        at = np.minimum(np.searchsorted(k, x), max(len(k) - 1, 0))
        hit = (k[at] == x) if len(k) else np.zeros(len(x), bool)
        lp[todo[hit]] = weight[todo[hit]] + p[at[hit]]
        todo, x = todo[~hit], x[~hit]
        if not len(todo):
            break
        c = x >> np.uint64(16)
        at = np.minimum(np.searchsorted(ctx, c), max(len(ctx) - 1, 0))
        seen = (ctx[at] == c) if len(ctx) else np.zeros(len(c), bool)
        weight[todo[seen]] += left[at[seen]]
    lp[todo] = weight[todo] + floor
    return lp[inv]


def _group():
    return F.coalesce(F.col("lang"), F.lit("?"))


def _by_group(groups, texts):
    """For each group the places of its texts, their words in a row, and how many each has."""
    from collections import defaultdict

    import numpy as np

    at = defaultdict(list)
    for i, g in enumerate(groups):
        at[g].append(i)
    for g, places in at.items():
        n = np.array([len(texts[i]) for i in places], np.int64)
        yield g, np.array(places), [w for i in places for w in texts[i]], n


def _count(batches):
    """Each task's n-gram counts by language group, through its words' and joints' counts."""
    import numpy as np
    import pyarrow as pa

    held: dict = {}  # group -> words, their inner n-grams and sizes, how often each came, joints and how often
    grams: dict = {}

    def merged(keys, counts):
        uniq, inv = np.unique(keys, return_inverse=True)
        return uniq, np.bincount(inv, counts, len(uniq)).astype(np.int64)

    def fold():
        for g, (_, keys, sizes, seen, joint, times) in held.items():
            first, second = joint_grams(joint)
            old = grams.get(g, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            grams[g] = merged(np.concatenate([old[0], *keys, first, second]), np.concatenate([old[1], np.repeat(seen, np.concatenate(sizes)), times, times]))
        held.clear()

    for b in batches:
        for groups, bodies in by_bytes(b.column("grp"), b.column("body")):
            for g, _, words, n in _by_group(groups, [raw.split() for raw in bodies]):
                if not words:
                    continue
                have = held.setdefault(g, [Words(), [], [], np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)])
                ids, key, count = have[0].number(words)
                if key is not None:
                    have[1].append(key)
                    have[2].append(count)
                seen = np.bincount(ids, minlength=len(have[0].index))
                seen[: len(have[3])] += have[3]
                have[3] = seen
                opens = (np.cumsum(n) - n)[n > 0]
                joint, times = np.unique(joints(have[0].tail[ids], have[0].head[ids], opens), return_counts=True)
                have[4], have[5] = merged(np.concatenate([have[4], joint]), np.concatenate([have[5], times]))
            if sum(len(x[0].index) + len(x[4]) for x in held.values()) > 300_000:
                fold()
    fold()
    for g, (k, n) in grams.items():
        for i in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(k[i : i + 100_000]), pa.string()), pa.array(k[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["grp", "gram", "n"])


def count_ngrams(docs: DataFrame) -> DataFrame:
    """grp, gram, n over all words of all texts."""
    ship(docs.sparkSession)
    rows = docs.select(_group().alias("grp"), body().alias("body"))
    return rows.mapInArrow(trimmed(_count), "grp string, gram long, n long").groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, cache_words: int = 250_000, thin: int = 10_000) -> DataFrame:
    """doc_id, grp, the base statistics, n_predicted and log_ppl (null without words).

    ``thin``: a language of as many symbols has half the weight that a large one's model has.
    """
    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    counted = count_ngrams(docs).toArrow()  # types of character n-grams
    model = {}
    names, grp = np.unique(np.array(counted.column("grp").to_pylist(), dtype=object), return_inverse=True)
    gram, n = counted.column("gram").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    by_grp = np.split(np.argsort(grp, kind="stable"), np.cumsum(np.bincount(grp, minlength=len(names)))[:-1]) if len(names) else []
    for g, own in zip(names, by_grp):
        model[g] = fit_kneser_ney(gram[own], n[own]), 0.5 * float(n[own].sum()) / (float(n[own].sum()) + thin)
    every, inv = np.unique(gram, return_inverse=True)
    pooled = fit_kneser_ney(every, np.bincount(inv, n, len(every)))
    key = f"quality-{id(counted)}-{len(gram)}-{int(n.sum()) if len(n) else 0}"
    held = spark.sparkContext.broadcast((model, pooled))

    def run(batches):
        import pyarrow as pa

        cache = worker_state(key, dict)  # group -> words, log-probabilities of their inner n-grams, sorted joints and theirs
        own_models, pooled = held.value

        def both(g, grams, starts):
            return [np.add.reduceat(np.append(score_grams(m, grams), 0.0), np.minimum(starts, len(grams))) for m in (own_models[g][0], pooled)]

        def logs(g, words, opens):
            """Log-probability of each word of a row of texts."""
            have = cache.setdefault(g, [Words(), np.empty((2, 0)), np.empty(0, np.uint64), np.empty((2, 0))])
            ids, grams, count = have[0].number(words)
            if grams is not None:
                got = np.zeros((2, len(count)))
                some = count > 0
                if some.any():
                    got[:, some] = both(g, grams, (np.cumsum(count) - count)[some])
                have[1] = np.concatenate([have[1], got], axis=1)
            uniq, inv = np.unique(joints(have[0].tail[ids], have[0].head[ids], opens), return_inverse=True)
            at = np.searchsorted(have[2], uniq)
            new = uniq[(at == len(have[2])) | (have[2][np.minimum(at, max(len(have[2]) - 1, 0))] != uniq) if len(have[2]) else np.ones(len(uniq), bool)]
            if len(new):
                got = np.stack([sum(score_grams(m, x) for x in joint_grams(new)) for m in (own_models[g][0], pooled)])
                every = np.concatenate([have[2], new])
                order = np.argsort(every, kind="stable")
                have[2], have[3] = every[order], np.concatenate([have[3], got], axis=1)[:, order]
            own, other = have[1][:, ids] + have[3][:, np.searchsorted(have[2], uniq)][:, inv]
            share = own_models[g][1]
            return np.logaddexp(own + np.log(share), other + np.log1p(-share))

        for b in batches:
            for ids, groups, bodies in by_bytes(*(b.column(c) for c in ("doc_id", "grp", "body"))):
                if sum(len(x[0].index) + len(x[2]) for x in cache.values()) > cache_words:
                    cache.clear()
                rows = [text_stats(raw) for raw in bodies]
                lp = [None] * len(rows)
                for g, places, words, n in _by_group(groups, [r[0] for r in rows]):
                    if not words:
                        continue
                    some = n > 0
                    total = np.bincount(np.repeat(np.arange(len(n)), n), logs(g, words, (np.cumsum(n) - n)[some]), len(n))
                    for i, x in zip(places[some].tolist(), total[some].tolist()):
                        lp[i] = x
                size = [r[1] + r[5] + len(r[0]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(groups, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(r[0]) for r in rows], *([r[i] for r in rows] for i in range(1, 5)), size)), pa.array([None if x is None else -x / m for x, m in zip(lp, size)], pa.float64())],
                    names=["doc_id", "grp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_predicted", "log_ppl"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _group().alias("grp"), body().alias("body"))
    return rows.mapInArrow(trimmed(run, key), "doc_id long, grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_predicted long, log_ppl double")


def _pools(cells: dict, enough: int) -> tuple[dict, list]:
    """Which cells (language group, length class) stand in for which; cells: their counts of texts.

    The pools (cells -> number), and for each cell its own pool, the pool of all languages and the weight of its own.
    A class with ``enough`` texts stands for itself, a thinner one for the nearest lengths of its language that
    together have as many. A language without as many is weighed against the nearest lengths of all.
    """
    by_lang: dict = {}
    every: dict = {}
    for (g, s), n in cells.items():
        by_lang.setdefault(g, {})[s] = n
        every[s] = every.get(s, 0) + n
    pools: dict = {}

    def near(have, s):
        for d in range(max(abs(s - x) for x in have) + 1):
            inside = [x for x in have if abs(s - x) <= d]
            if sum(have[x] for x in inside) >= enough:
                break
        return inside

    def number(pool):
        return pools.setdefault(frozenset(pool), len(pools))

    shared = {s: number(c for c in cells if c[1] in set(near(every, s))) for s in every} if any(sum(h.values()) < enough for h in by_lang.values()) else {}
    out = []
    for g, have in by_lang.items():
        n = sum(have.values())
        for s in have:
            if n >= enough:
                out.append((g, s, number((g, x) for x in near(have, s)), None, 1.0))
            else:
                out.append((g, s, number((g, x) for x in have), shared[s], n / (n + 5)))
    return pools, out


def _bands(rows: DataFrame, below: float, above: float, least_sd: float, enough: int) -> DataFrame:
    """grp, size_class, lower_ppl, upper_ppl for every language group and doubling of length: a few hundred rows."""
    spark = rows.sparkSession
    found = rows.where("size_class is not null").groupBy("grp", "size_class").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")).collect()
    cells = {(r.grp, r.size_class): r.n for r in found}
    pools, targets = _pools(cells, enough)
    middle = {p: sum(cells[c] * c[1] for c in pool) / max(sum(cells[c] for c in pool), 1) for pool, p in pools.items()}
    size = {p: sum(cells[c] for c in pool) for pool, p in pools.items()}
    members = spark.createDataFrame([(g, s, p) for pool, p in pools.items() for g, s in pool], "grp string, size_class long, pool int")
    sound = rows.where(~F.col("base_failed")).select("grp", "size_class", "log_ppl").join(F.broadcast(members), ["grp", "size_class"])
    q = {r.pool: r.q for r in sound.groupBy("pool").agg(F.percentile_approx("log_ppl", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))), 10_000).alias("q")).collect()}

    def shape(pool, s):
        """Median and spread to each side, for a length below the pool's as wide as means of fewer symbols are."""
        a, b, c = q[pool]
        # Quartiles of few texts are uncertain, so their spread is taken wider: by half for twenty texts, a hundredth for a thousand.
        wider = 2 ** (max(middle[pool] - s, 0) / 2) * (1 + 10 / max(size[pool], 1))
        return b, (b - a) * wider, (c - b) * wider

    out = []
    for g, s, pool, back, w in targets:
        have = [p for p in (pool, back) if p in q]
        if not have:
            continue
        own, other = shape(have[0], s), shape(have[-1], s)
        at, low, high = (w * x + (1 - w) * y for x, y in zip(own, other))
        # A thin language of lower perplexity than all of them isn't suspect for that.
        out.append((g, s, math.exp(min(at, own[0]) - below * (low / 0.674 + least_sd)), math.exp(at + above * (high / 0.674 + least_sd))))
    return spark.createDataFrame(out, "grp string, size_class long, lower_ppl double, upper_ppl double")


def judge(docs: DataFrame, below: float = 3.5, above: float = 12.0, least_sd: float = 0.004, enough: int = 50) -> DataFrame:
    """The statistics of every document with base_failed, its perplexity, the band, and kept.

    A length class with fewer than ``enough`` texts is judged by its neighbours' band too.
    """
    rows = materialize(score(docs), "quality").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumn("size_class", F.floor(F.log2("n_predicted")))
    bands = _bands(rows, below, above, least_sd, enough)
    out = rows.join(F.broadcast(bands), ["grp", "size_class"], "left").withColumn("perplexity", F.exp("log_ppl"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("lower_ppl"), F.col("upper_ppl")), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "perplexity", "lower_ppl", "upper_ppl")
