"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each text keeps the minimum ``gram``-word hash of every sliding window of ``window`` words. A shared
span of ``window`` words has the same minimum in both, so joining the two sets of fingerprints finds
every document that can hold a benchmark window, without moving any text. Where a fingerprint of the
benchmark occurs in such a document, the hit is extended: the windows around it, and no others, are
compared with the benchmark's word by word, and the covered words are counted. Items shorter than a
window are one window of their own length; their hashes are joined with all grams of that length, for
lengths that occur.

The benchmark's fingerprints and windows and the suspects are written tables, so Spark broadcasts them
while their size allows and shuffles, and splits hot keys, beyond.

Edge cases: null and wordless texts and items hold nothing; an empty benchmark leaves every document
clean; an empty table of documents gives an empty result; repeated items each count; rows that repeat a
doc_id, or have none, are judged by their own text; equal texts get equal results; extra columns are ignored.
"""
from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: ASCII characters that separate words: all but digits and letters.
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(col: str = "text"):
    """Words of digits, letters (A-Z lower-cased) and all characters beyond ASCII."""
    text = F.translate(F.coalesce(F.col(col).cast("string"), F.lit("")), BREAKS + string.ascii_uppercase, " " * len(BREAKS) + string.ascii_lowercase)
    return F.array_remove(F.split(text, " "), "")


def _grams(hashes: str, n: int):
    """Hashes of all runs of n word hashes; empty if there are fewer."""
    h = F.col(hashes)
    return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))).otherwise(F.array().cast("array<long>"))


# explode_outer throughout: Spark infers from explode() a filter size(...) > 0, pushes it below the projections
# and so evaluates the whole winnowing once more, inlined into its own lambdas.


def _minima(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds fps: the distinct minima of all windows of ``words``; keeps h, the words' hashes."""
    span = window - gram + 1
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("g", _grams("h", gram))
    g = F.col("g")
    fps = F.when(F.size(g) >= span, F.transform(F.sequence(F.lit(1), F.size(g) - (span - 1)), lambda i: F.array_min(F.slice(g, i, span)))).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("fps", F.array_distinct(fps)).drop("g")


def _marked(hashes, n: int):
    return F.transform(hashes, lambda x: F.struct(F.lit(n).alias("len"), x.alias("fp")))


def fingerprints(rows: DataFrame, window: int, gram: int, shorter: list[int]) -> DataFrame:
    """Adds marks: (len, fp) of each distinct window minimum (len = window) and of the grams of each shorter length."""
    rows = _minima(rows, window, gram)
    marks = _marked(F.col("fps"), window)
    for n in shorter:
        marks = F.concat(marks, _marked(F.array_distinct(_grams("h", n)), n))
    return rows.withColumn("marks", marks).drop("h", "fps")


def _at(words, start, n: int):
    return F.struct(start.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice(words, start + 1, n), " ").alias("w"))


def _from(starts, n: int):
    return F.transform(starts, lambda s: _at(F.col("words"), s, n))


def _windows(words, n: int):
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: _at(words, i, n))).otherwise(F.array().cast("array<struct<at:int,len:int,w:string>>"))


def _where(grams: str, found, n: int):
    """Places of the grams of length n that are among the found (len, fp)."""
    own = F.transform(F.filter(found, lambda x: x["len"] == n), lambda x: x["fp"])
    g = F.col(grams)
    return F.when((F.size(own) > 0) & (F.size(g) > 0), F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(own, F.get(g, i)))).otherwise(F.array().cast("array<int>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted strings) for every row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of().alias("words")).withColumn("n", F.size("words")).where("n > 0")
    shorter = sorted(r[0] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # fewer than `window` numbers
    full = items.where(F.col("n") >= window)
    held = full.select("item_id", F.explode_outer(_windows(F.col("words"), window)).alias("x")).select("item_id", "x.w")
    held = materialize(held.unionByName(items.where(F.col("n") < window).select("item_id", F.array_join("words", " ").alias("w"))).distinct(), "held")
    wanted = materialize(held.select("w").distinct(), "wanted")
    bench = _minima(full, window, gram).select(F.lit(window).alias("len"), F.explode_outer("fps").alias("fp"))
    for n in shorter:
        small = items.where(F.col("n") == n).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
        bench = bench.unionByName(small.select(F.lit(n).alias("len"), F.explode_outer(_grams("h", n)).alias("fp")))
    bench = materialize(bench.distinct(), "bench")
    # A row is known by its doc_id (null as the least number) and the hash of its text.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("k"))
    marks = fingerprints(rows.select("d", "k", words_of().alias("words")), window, gram, shorter)
    found = marks.select("d", "k", F.explode_outer("marks").alias("m")).select("d", "k", "m.len", "m.fp").join(bench, ["len", "fp"], "left_semi")
    suspects = materialize(found.groupBy("d", "k").agg(F.collect_set(F.struct("len", "fp")).alias("found")), "suspects")
    # Extension: the windows that hold a found gram.
    texts = rows.select("d", "k", "text").join(suspects, ["d", "k"]).select("d", "k", "found", words_of().alias("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("g", _grams("h", gram))
    # A found minimum is a gram of `gram` words; its windows begin up to span - 1 words before it.
    last = F.size("words") - window
    places = texts.withColumn("p", _where("g", F.col("found"), window))
    starts = F.array_distinct(F.flatten(F.transform("p", lambda i: F.sequence(F.greatest(i - (window - gram), F.lit(0)), F.greatest(F.least(i, F.col("last")), F.greatest(i - (window - gram), F.lit(0)))))))
    places = places.withColumn("last", last).withColumn("starts", F.filter(starts, lambda s: s <= F.col("last")))
    spots = _from(F.col("starts"), window)
    for n in shorter:
        places = places.withColumn(f"g{n}", _grams("h", n)).withColumn(f"p{n}", _where(f"g{n}", F.col("found"), n))
        spots = F.concat(spots, _from(F.col(f"p{n}"), n))
    spots = places.select("d", "k", F.explode_outer(spots).alias("x")).select("d", "k", "x.at", "x.len", "x.w")
    hits = materialize(spots.join(wanted, "w", "left_semi"), "hits")
    # Covered words: the union of a document's hit intervals, in order.
    union = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["at"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
    )
    covered = hits.groupBy("d", "k").agg(union["n"].cast("long").alias("n_hit"))
    named = hits.select("d", "k", "w").distinct().join(held, "w").groupBy("d", "k").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    judged = materialize(covered.join(named, ["d", "k"]), "judged")
    none = F.array().cast("array<string>")
    out = rows.select("doc_id", "d", "k", F.size(words_of()).cast("long").alias("n_words")).join(judged, ["d", "k"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
