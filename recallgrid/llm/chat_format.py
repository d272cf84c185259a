"""Chat transcripts: roles recovered by a hidden Markov model, then canonical rendering.

A row's text is parsed first: where a line opens with a speaker marker ("User:", "**Assistant:**",
"<|im_start|>system", "[Bot]", "## Human"), a new part of the row begins, so a row that holds a whole
transcript yields its turns. Markers are taken off; a first line that is a word only stays.

Hidden states are roles. A part is observed through categorical features: its marker, its length class,
its number of lines, a question mark, list or code marks. Initial, transition and emission probabilities
are smoothed counts over transcripts whose roles are known, made in Spark; a marker speaks for its role beforehand. Viterbi decoding is exact and
blocked: parts are sorted over all partitions, each run of ``block`` parts of a transcript within a
partition is one max-plus matrix from state to state, the matrices of a transcript are scanned once to fix
the states at the cuts, and each block is then decoded between its fixed ends. So a transcript of any
length, or any number of rows without one, costs one task no more than its number of blocks.

Canonical rendering: ``<|role|>``, a line break, the text without its marker and outer white space,
a line break, ``<|end|>``.

Edge cases: null and empty texts are turns with their own length class; null turns come first;
repeated turn numbers are ordered by text; a null conv_id is one transcript; roles that are null or
unknown, and those of rows with several parts, don't train; without any the probabilities are even; an
empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker, by role; a parameter of the operator.
MARKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "customer", "question", "q", "prompt", "me"],
    "assistant": ["assistant", "ai", "bot", "agent", "answer", "a", "model", "response"],
}
_BY_WORD = {w: r for r, ws in MARKERS.items() for w in ws}
#: Those that open a turn within a text too; the others are too common at the start of a line.
SPEAKERS = ["system", "user", "human", "customer", "assistant", "ai", "bot", "agent"]


def _marks(words) -> str:
    w = "|".join(sorted(words, key=len, reverse=True))
    return rf"^[ \t]*(?:<\|im_start\|>[ \t]*(?:{w})[ \t]*$|<\|(?:{w})\|>|\[(?:{w})\]:?|\#{{1,4}}[ \t]*(?:{w})[ \t]*:?[ \t]*$|\*\*(?:{w})[ \t]*:?\*\*:?|(?:{w})[ \t]*:(?=\s|$))"


_FIRST = re.compile(r"\s*" + _marks(_BY_WORD)[1:], re.I | re.M)
_LATER = re.compile(_marks(SPEAKERS), re.I | re.M)
_WORD = re.compile(r"[a-z]+")
_CLOSED = re.compile(r"\s*<\|(?:im_end|end|eot_id)\|>\s*$")
FEATURES = ("mark", "length", "lines", "question", "marks")
WIDTHS = (4, 16, 8, 3, 4)


def parts_of(text: str) -> list[tuple[str | None, str]]:
    """(role the marker names, text) of each part of a row, at least one."""
    role = lambda m: next(_BY_WORD[w] for w in reversed(_WORD.findall(m[0].lower())) if w in _BY_WORD)
    first = _FIRST.match(text)
    at, who, out = (first.end(), role(first), []) if first else (0, None, [])
    for m in _LATER.finditer(text, at):
        if who is not None or text[at : m.start()].strip():
            out.append((who, text[at : m.start()]))
        at, who = m.end(), role(m)
    out.append((who, text[at:]))
    return [(w, _CLOSED.sub("", t).strip()) for w, t in out]


def observe(mark: str | None, own: str) -> list[int]:
    """A part's features' values (small ints)."""
    return [
        0 if mark is None else 1 + ROLES.index(mark), min(len(own).bit_length(), 15), min(own.count("\n").bit_length(), 7),
        int(own.endswith("?")) + int("?" in own), int("```" in own) + 2 * bool(re.search(r"(?m)^\s*(?:[-*]|\d+[.)])\s", own)),
    ]


def _observed(batches):
    import pyarrow as pa

    for b in batches:
        at, part, many, own, xs = [], [], [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            got = parts_of(text or "")
            for n, (mark, t) in enumerate(got):
                at.append(i)
                part.append(n)
                many.append(len(got))
                own.append(t)
                xs.append(observe(mark, t))
        take = pa.array(at, pa.int64())
        keep = [n for n in b.schema.names if n != "text"]
        cols = [b.column(n).take(take) for n in keep] + [pa.array(part, pa.int32()), pa.array(many, pa.int32()), pa.array(own, pa.string()), pa.array(xs, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, names=[*keep, "part", "parts", "body", "x"])


def _numbered(batches):
    """Adds piece (this partition) and rn, the running number within a transcript, to sorted rows."""
    import pyarrow as pa
    from pyspark import TaskContext

    piece, now, n = TaskContext.get().partitionId(), object(), 0
    for b in batches:
        rn = []
        for c in b.column("conv_id").to_pylist():
            now, n = (c, n + 1) if c == now else (c, 0)
            rn.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([piece] * len(rn), pa.int32()), pa.array(rn, pa.int64())], names=[*b.schema.names, "piece", "rn"])


def fit(parts: DataFrame, smooth: float = 0.5):
    """(log initial, log transition, log emissions by feature) from conv_id, turn, parts, role, x."""
    import numpy as np

    k = len(ROLES)
    a, first, e = np.full((k, k), smooth), np.full(k, smooth), [np.full((k, w), smooth) for w in WIDTHS]
    known = parts.where(F.col("role").isin(list(ROLES)) & (F.col("parts") == 1))
    for role, f, v, n in known.select("role", F.posexplode("x").alias("f", "v")).groupBy("role", "f", "v").count().collect():  # at most roles x values
        e[f][ROLES.index(role), v] += n
    # Values that no role's turns have tell nothing, however many turns a role has.
    e = [x + 0.02 * x.sum(1, keepdims=True) / x.shape[1] for x in (y - smooth + 1e-3 for y in e)]
    # Markers name their role, also where the training turns have none.
    named = np.full((k, k + 1), 0.005)
    named[:, 0] = 1 - 0.1
    named[np.arange(k), 1 + np.arange(k)] = 0.1 - 0.005 * (k - 1)
    e[0] += 0.05 * e[0].sum(1, keepdims=True) * named
    own = known.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    nxt = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("then"))
    for role, then, n in own.join(nxt, ["conv_id", "turn"]).groupBy("role", "then").count().collect():
        a[ROLES.index(role), ROLES.index(then)] += n
    for role, n in known.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("s")).groupBy("s.role").count().collect():
        first[ROLES.index(role)] += n
    return np.log(first / first.sum()), np.log(a / a.sum(1, keepdims=True)), [np.log(x / x.sum(1, keepdims=True)) for x in e]


def _emission(model, x):
    return sum(e[:, v] for e, v in zip(model[2], x))


def block_matrix(model, xs):
    """Best log-score from the state before a block, in the last row from none (it opens), to its last state."""
    import numpy as np

    first, a, _ = model
    m = None
    for x in xs:
        e = _emission(model, x)
        m = np.vstack([a, first]) + e if m is None else (m[:, :, None] + a[None]).max(1) + e
    return m


def decode_block(model, xs, before: int | None, last: int) -> list[int]:
    """The best states of a block that follows state ``before`` (None: opens) and ends in ``last``."""
    import numpy as np

    first, a, _ = model
    score, back = None, []
    for x in xs:
        e = _emission(model, x)
        if score is None:
            score = (first if before is None else a[before]) + e
        else:
            step = score[:, None] + a
            back.append(step.argmax(0))
            score = step.max(0) + e
    path = [last]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return path[::-1]


def scan(model, blocks) -> list[tuple[int | None, int]]:
    """For a transcript's block matrices in order: the state before each block, and its last."""
    score, back = None, []
    for m in blocks:
        if score is None:
            score = m[-1]
        else:
            step = score[:, None] + m[:-1]
            back.append(step.argmax(0))
            score = step.max(0)
    ends = [int(score.argmax())]
    for p in reversed(back):
        ends.append(int(p[ends[-1]]))
    ends = ends[::-1]
    return list(zip([None, *ends[:-1]], ends))


def _groups(batches, keys):
    """Consecutive rows with equal keys, from sorted batches."""
    key, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            k = tuple(r[x] for x in keys)
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(r)
    if rows:
        yield key, rows


def _out(rows, schema, size=5_000):
    import pyarrow as pa

    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def recover_roles(turns: DataFrame, known: DataFrame | None = None, block: int = 256) -> DataFrame:
    """conv_id, turn, part, role (recovered), rendered for every part of every row of (conv_id, turn, text).

    ``known``: (conv_id, turn, role) that train the model; by default the roles of ``turns``.
    """
    import pyarrow as pa

    spark = turns.sparkSession
    ship(spark)
    role = F.col("role") if "role" in turns.columns else F.lit(None)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.cast("string").alias("role"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    schema = "conv_id long, turn long, role string, h long, row long, part int, parts int, body string, x array<int>"
    seen = materialize(rows.mapInArrow(_observed, schema), "parts")
    train = seen
    if known is not None:
        k = known.select(F.col("conv_id").cast("long").alias("kc"), F.col("turn").cast("long").alias("kt"), F.col("role").cast("string").alias("kr")).distinct()
        train = seen.drop("role").join(k, (F.col("conv_id") == F.col("kc")) & (F.col("turn") == F.col("kt"))).withColumnRenamed("kr", "role")
    held = spark.sparkContext.broadcast(fit(train))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "h", "row", "part"]
    ranked = seen.drop("role", "parts").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_numbered, "conv_id long, turn long, h long, row long, part int, body string, x array<int>, piece int, rn long")
    key = ["conv_id", "piece", "block"]
    ranked = materialize(ranked.drop("h", "row").withColumn("block", F.floor(F.col("rn") / block)), "ranked")
    sliced = lambda df: df.repartition(n, *key).sortWithinPartitions(*key, "rn")

    def matrices(batches):
        def rows():
            for (c, p, b), rs in _groups(batches, key):
                yield {"conv_id": c, "piece": p, "block": b, "m": block_matrix(held.value, [r["x"] for r in rs]).ravel().tolist()}

        return _out(rows(), pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("block", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def ends(batches):
        import numpy as np

        def rows():
            for (c,), rs in _groups(batches, ("conv_id",)):
                for r, (before, last) in zip(rs, scan(held.value, [np.array(r["m"]).reshape(-1, len(ROLES)) for r in rs])):
                    yield {"conv_id": c, "piece": r["piece"], "block": r["block"], "before": before, "last": last}

        return _out(rows(), pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("block", pa.int64()), ("before", pa.int32()), ("last", pa.int32())]))

    blocks = sliced(ranked.select(*key, "rn", "x")).mapInArrow(matrices, "conv_id long, piece int, block long, m array<double>")
    fixed = blocks.repartition(n, "conv_id").sortWithinPartitions(*key).mapInArrow(ends, "conv_id long, piece int, block long, before int, last int")
    fixed = materialize(fixed, "ends").withColumnsRenamed({"conv_id": "c", "piece": "p", "block": "b"})
    joined = ranked.join(fixed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("block") == F.col("b"))).drop("c", "p", "b")

    def decoded(batches):
        def rows():
            for _, rs in _groups(batches, key):
                for r, s in zip(rs, decode_block(held.value, [r["x"] for r in rs], rs[0]["before"], rs[0]["last"])):
                    yield {"conv_id": r["conv_id"], "turn": r["turn"], "part": r["part"], "role": ROLES[s], "rendered": f"<|{ROLES[s]}|>\n{r['body']}\n<|end|>"}

        return _out(rows(), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("rendered", pa.string())]))

    return sliced(joined).mapInArrow(decoded, "conv_id long, turn long, part int, role string, rendered string")
