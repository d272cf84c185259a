"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs.

Leaf i holds ``rank * n + i`` for the pair that starts at symbol i, inner nodes the minimum of their
children, so the root names the leftmost pair of lowest rank. A merge changes three leaves, each
updated in O(log n), until the root is empty. Normalisation and splitting follow the vocabulary
file: NFC, lower case, the split pattern, and byte-level symbols with an end-of-word mark. The
strings of special tokens in a text become their ids, as the tokenizers library does by default.

Edge cases: null and empty texts give no tokens; a text of any length is encoded whole; words of
any length cost O(n log n); repeated texts are separate rows; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, ship, worker_state

#: White space as the tokenizers library's pattern engine has it, fixed by the Unicode standard.
SPACE = r"\t-\r \x85\xa0  -     　"
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free code point from 256."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class SegmentTreeBPE:
    def __init__(self, spec: bytes | str, cache_words: int = 300_000):
        import regex

        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.base = len(self.names) + 1
        self.rank, self.made = {}, []
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] * self.base + vocab[b], k)
            self.made.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + END] for s in symbols]
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.cache, self.cache_words = {}, cache_words

    def merge(self, ids: list[int]) -> list[int]:
        """Merge until no adjacent pair is in the table."""
        n = len(ids)
        if n < 2:
            return ids
        rank, base, none = self.rank.get, self.base, 1 << 62
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] * base + ids[i + 1])
            if r is not None:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                a = a if a < b else b
                if tree[i] == a:
                    break
                tree[i] = a

        while (top := tree[1]) != none:
            r, i = divmod(top, n)
            j = after[i]
            ids[i], ids[j] = self.made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                got = rank(ids[i] * base + ids[k])
                put(j, none) if j < n - 1 else None
                put(i, none if got is None else got * n + i)
            else:
                put(j, none) if j < n - 1 else None
                put(i, none)
            if (p := before[i]) >= 0:
                got = rank(ids[p] * base + ids[i])
                put(p, none if got is None else got * n + p)
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> tuple[int, str, str]:
        raw = word.encode()
        ids = self.merge([self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]])
        return len(ids), " ".join(map(str, ids)), " ".join(self.names[i] for i in ids)

    def encode(self, text: str) -> tuple[int, str, str]:
        """How many tokens, their ids and their strings, each joined by one space."""
        found, cache = [], self.cache
        for part in self.cut(text) if self.cut else (text,):
            if part in self.special:
                found.append((1, str(self.special[part]), part))
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            for w in self.split(part.lower()):
                got = cache.get(w)
                if got is None:
                    got = self.word(w)
                    if len(w) < 64:
                        if len(cache) >= self.cache_words:
                            cache.clear()
                        cache[w] = got
                found.append(got)
        if not found:
            return 0, "", ""
        counts, ids, names = zip(*found)
        return sum(counts), " ".join(ids), " ".join(names)


def encode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; keep_ids adds ids (array<int>) and decoded."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:  # the driver's file; workers get its few MB by broadcast
        raw = f.read()
    key, spec = "bpe-" + hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    def run(batches):
        import pyarrow as pa

        coder = worker_state(key, lambda: SegmentTreeBPE(spec.value))
        for b in batches:
            n, i, d, ids, names = [], [], [], [], []
            for raw in b.column("body").to_pylist():
                c, x, y = coder.encode(raw.decode("utf-8", "replace"))
                n.append(c)
                i.append(hashlib.sha256(x.encode()).hexdigest())
                d.append(hashlib.sha256(y.encode()).hexdigest())
                if keep_ids:
                    ids.append(list(map(int, x.split())))
                    names.append(y)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
            if keep_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("body")).mapInArrow(run, schema)
