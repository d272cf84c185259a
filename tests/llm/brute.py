"""Plain-Python versions of the operators' contracts, for small inputs."""
import hashlib
import itertools
import math
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def substring(docs, window=50):
    """docs: (doc_id, text) -> {doc_id: (n_words, n_removed, kept_sha256)}"""
    first, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d, ws in words.items():
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, ws in words.items():
        cut = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                cut.update(range(i, i + window))
        kept = [w for i, w in enumerate(ws) if i not in cut]
        out[d] = (len(ws), len(cut), sha(" ".join(kept)))
    return out


def simhash(text):
    ws = WORD.findall(lower(text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near(docs, radius=2):
    fp = {d: simhash(t) for d, t in docs}
    by = defaultdict(list)
    for d, f in fp.items():
        by[f].append(d)
    root = {f: f for f in by}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = list(by)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in fp.items():
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return {d: (f"{f:016x}", least[find(f)]) for d, f in fp.items()}


BWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for k, t in items:
        ws = BWORD.findall(lower(t or ""))
        for i in range(max(len(ws) - window, 0) + 1):
            if w := tuple(ws[i : i + window]):
                wins[w].add(k)
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        ws = BWORD.findall(lower(t or ""))
        hit, got = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    got |= wins[w]
        out[d] = (len(ws), len(hit), len(got), sha(",".join(sorted(map(str, got)))), bool(hit))
    return out


def base_rules(text):
    t = text or ""
    ws = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    at = defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    rep = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(rep), len(ws) < 10 or 100 * len(rep) > 20 * len(ws)


def units(text):
    """The UTF-16 code units of a text's words in order, each word followed by a boundary."""
    raw = "".join(w + "\n" for w in WORD.findall(text or "")).encode("utf-16-le")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


class KneserNey:
    """Interpolated modified Kneser-Ney of order four over rows of symbols, by dictionaries."""

    def __init__(self, rows):
        tables = [defaultdict(int) for _ in range(4)]
        for row in rows:
            row = [10, 10, 10, *row]
            for i in range(3, len(row)):
                tables[3][tuple(row[i - 3 : i + 1])] += 1
        for n in (2, 1, 0):
            for gram in tables[n + 1]:
                tables[n][gram[1:]] += 1
        self.tables, self.discounts, self.totals = tables, [], []
        self.raw = [defaultdict(int) for _ in range(4)]
        for gram, c in tables[3].items():
            for n in range(4):
                self.raw[n][gram[3 - n :]] += c
        self.contexts = [defaultdict(int) for _ in range(4)]
        for n in range(4):
            for gram, c in self.raw[n].items():
                self.contexts[n][gram[:-1]] += c
        for t in tables:
            n1, n2, n3, n4 = (max(sum(c == i for c in t.values()), 1) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            self.discounts.append([0, min(max(1 - 2 * y * n2 / n1, 0.1), 0.95), min(max(2 - 3 * y * n3 / n2, 0.1), 1.9), min(max(3 - 4 * y * n4 / n3, 0.1), 2.85)])
            total = defaultdict(lambda: [0, 0.0])
            for gram, c in t.items():
                total[gram[:-1]][0] += c
                total[gram[:-1]][1] += self.discounts[-1][min(c, 3)]
            self.totals.append(total)

    def estimate(self, gram):
        n = len(gram)
        if not n:
            return 1 / (len(self.tables[0]) + 1)
        c, (total, off) = self.tables[n - 1][gram], self.totals[n - 1][gram[:-1]]
        return (c - self.discounts[n - 1][min(c, 3)]) / total + off / total * self.estimate(gram[1:])

    def p(self, gram):
        """The estimate, by the longest end of the n-gram that occurs twice or more."""
        n = len(gram)
        if not n or self.raw[n - 1].get(gram, 0) > 1:
            return self.estimate(gram)
        if self.contexts[n - 1].get(gram[:-1], 0) < 2:
            return self.p(gram[1:])
        total, off = self.totals[n - 1][gram[:-1]]
        return off / total * self.p(gram[1:])

    def words(self, row):
        """Log-probability of each word with its closing boundary."""
        row, out = [10, 10, 10, *row], [0.0]
        for i in range(3, len(row)):
            out[-1] += math.log(self.p(tuple(row[i - 3 : i + 1])))
            if row[i] == 10:
                out.append(0.0)
        return out[:-1]


def perplexities(docs, thin=10_000):
    """docs: (doc_id, text, lang) -> {doc_id: perplexity, None without words}"""
    rows = {d: (units(t), lang or "?") for d, t, lang in docs}
    by = defaultdict(list)
    for row, g in rows.values():
        by[g].append(row)
    models = {g: KneserNey(r) for g, r in by.items()}
    size = {g: sum(map(len, r)) for g, r in by.items()}
    # The counts of all languages are the sums of theirs.
    pooled = KneserNey([r for row in by.values() for r in row])
    out = {}
    for d, (row, g) in rows.items():
        share = 0.5 * size[g] / (size[g] + thin)
        lp = sum(math.log(share * math.exp(a) + (1 - share) * math.exp(b)) for a, b in zip(models[g].words(row), pooled.words(row)))
        out[d] = math.exp(-lp / len(row)) if row else None
    return out


def shards(docs, n=24):
    """docs: (doc_id, text) -> rows (doc_id, size, crc, shard, slot), by the order of (first 60 bits of MD5, doc_id)."""
    rows = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    total, at, out, slots = sum(r[2] for r in rows), 0, [], defaultdict(int)
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        whole = sum(r[2] for r in group)
        together, lo = len(group) > 1 and whole * n * 50 <= total, at
        for _, d, size, crc in group:
            middle = 2 * lo + whole if together else 2 * at + size
            k = min(middle * n // (2 * max(total, 1)), n - 1)
            out.append((d, size, crc, k, slots[k]))
            slots[k] += 1
            at += size
    return out


def viterbi(model, xs):
    """States of one transcript by the plain recursion."""
    first, a, emissions = model
    score, back = None, []
    for x in xs:
        e = [sum(f[s][v] for f, v in zip(emissions, x)) for s in range(len(first))]
        if score is None:
            score = [first[s] + e[s] for s in range(len(e))]
        else:
            best = [max(range(len(e)), key=lambda r, s=s: score[r] + a[r][s]) for s in range(len(e))]
            back.append(best)
            score = [score[best[s]] + a[best[s]][s] + e[s] for s in range(len(e))]
    path = [max(range(len(score)), key=score.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]
