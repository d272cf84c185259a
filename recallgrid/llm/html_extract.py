"""Main text of web pages by wrapper induction.

Each page becomes a small tree of its block elements by tag and class, like siblings as one node, with a
hash of each node's own text and its length in and outside of links. For each host one page of its most
common layout is the seed, and every page of the host is aligned with it by simple tree matching (the
largest order-preserving mapping of children, level by level). Counts over distinct trees, so that copies
count once, make the seed a wrapper: nodes with the same text in nearly all pages are template, the others
are slots, and the region below which most of the slots' text lies is the content. A page is aligned with
its host's wrapper again; what lies outside of the region and the template's texts are dropped, and the
slots within yield the text.

What the wrapper leaves is judged by markup: elements that name themselves menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments go, and so do blocks of three links or
more, mostly linked, outside of article and main, and there any list of nothing but links if article or main
has text. That alone decides pages whose host has one distinct tree, hosts whose pages are
copies of one, and those without a clear region. A host's pages meet in no single task: alignment counts
are summed in each task and by (host, node).

Edge cases: null and empty html gives an empty text; pages without a host form a host of their own;
markup of any depth is walked with explicit stacks; repeated page_ids are separate rows; broken markup is
read as it comes; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import json
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, materialize, ship

#: Elements by their role in HTML; fixed values of its standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title svg math iframe object".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
AWAY = set("head nav footer aside form button select menu dialog label fieldset".split())
#: Words of class, id and role that name what isn't content.
NAMED = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search social share sharing related recommended pagination pager toolbar widget widgets copyright legal skip complementary contentinfo".split())
_FENCE = ("article", "main", "body", "td", "table")
_ITEMS = ("li", "dd", "dt", "td", "th", "tr", "option")
_STOP = ("li", "ul", "ol", "td", "th", "div", "article", "section", "main", "body", "blockquote", "table", "nav", "aside", "footer", "header", "form")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "sig", "names", "kids", "parent")

    def __init__(self, tag, sig, names, parent):
        self.tag, self.sig, self.names, self.parent, self.kids = tag, sig, names, parent, []



def parse(html: str) -> Node:
    """The page's tree: kids are nodes and decoded strings."""
    root = Node("", "", (), None)
    stack, total, frames = [root], Counter(), [Counter()]
    at, n, find = 0, len(html), _TOKEN.search

    def pop():
        tag = stack.pop().tag
        total[tag] -= 1
        if tag in _FENCE:
            frames.pop()
        frames[-1][tag] -= 1

    while at < n:
        m = find(html, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].kids.append(unescape(html[at:end]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            # An inline element's end reaches no further than the enclosing article, cell or body.
            if total[tag] if tag in BLOCK else frames[-1][tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in CLOSES_P and total["p"] or tag in _ITEMS and (total[tag] or tag in ("dd", "dt") and total["dd"] + total["dt"]):
            for depth in range(len(stack) - 1, 0, -1):
                have = stack[depth].tag
                if have == "p" and tag in CLOSES_P or have == tag and tag in ("li", "td", "th", "tr", "option") or have in ("dd", "dt") and tag in ("dd", "dt"):
                    while len(stack) > depth:
                        pop()
                    break
                if have in _STOP:
                    break
        names = ()
        if m[3] and "=" in m[3]:
            names = tuple(sorted({w for a in _ATTR.finditer(m[3]) for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())}))
        node = Node(tag, tag + ("." + ".".join(names) if names else ""), names, stack[-1])
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            at = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(html, at).end()
            continue
        frames[-1][tag] += 1
        if tag in _FENCE:
            frames.append(Counter())
        total[tag] += 1
        stack.append(node)
    return root


def skeleton(root: Node) -> tuple[list, list]:
    """The tree as parallel lists [signatures, parents, text hashes, characters, linked characters], parents first; and each entry's nodes."""
    import xxhash

    sigs, parents, hashes, chars, linked, held = [root.sig], [-1], [], [], [], [[root]]
    at = 0
    while at < len(held):
        texts, links, kids = [], 0, {}
        todo = [(k, False) for x in reversed(held[at]) for k in reversed(x.kids)]
        while todo:
            k, inside = todo.pop()
            if isinstance(k, str):
                texts.append(k)
                if inside:
                    links += len("".join(k.split()))
            elif k.tag in BLOCK:
                kids.setdefault(k.sig, []).append(k)
            elif k.tag not in RAW:
                inside = inside or k.tag == "a"
                todo.extend((x, inside) for x in reversed(k.kids))
        words = " ".join("".join(texts).split())
        hashes.append(xxhash.xxh3_64_intdigest(words) >> 12)
        chars.append(len(words.replace(" ", "")))
        linked.append(links)
        for sig, nodes in kids.items():
            sigs.append(sig)
            parents.append(at)
            held.append(nodes)
        at += 1
    return [sigs, parents, hashes, chars, linked], held


def _children(tree: list) -> list[list[int]]:
    kids: list = [[] for _ in tree[0]]
    for i, p in enumerate(tree[1]):
        if p >= 0:
            kids[p].append(i)
    return kids


def _in_order(pairs: list[tuple[int, int, int]]) -> list[int]:
    """Of (place in b, weight, pair) in the order of a, the pairs of the heaviest increasing run of places."""
    if all(x[0] < y[0] for x, y in zip(pairs, pairs[1:])):
        return [p for _, _, p in pairs]
    size = max(x[0] for x in pairs) + 2
    best: list = [(0, -1)] * (size + 1)  # a Fenwick tree of (weight so far, index of the last pair)
    before = []
    for k, (place, w, _) in enumerate(pairs):
        i, top = place, (0, -1)
        while i > 0:
            top = max(top, best[i])
            i -= i & -i
        before.append(top[1])
        i, now = place + 1, (top[0] + w, k)
        while i <= size:
            best[i] = max(best[i], now)
            i += i & -i
    i, top = size, (0, -1)
    while i > 0:
        top = max(top, best[i])
        i -= i & -i
    out, k = [], top[1]
    while k >= 0:
        out.append(pairs[k][2])
        k = before[k]
    return out


def match(a: list, b: list) -> list[tuple[int, int, bool]]:
    """Simple tree matching: the aligned nodes of a and b, and whether their own texts agree.

    Siblings have distinct signatures, so a node can only meet the one of its signature below the partner of
    its parent; of these the heaviest that keep their order are aligned.
    """
    if a[0][0] != b[0][0]:
        return []
    ka, kb = _children(a), _children(b)
    pairs, kids = [(0, 0)], []
    for i, j in pairs:  # grows while it is read
        place = {b[0][y]: (n, y) for n, y in enumerate(kb[j])}
        mine = []
        for x in ka[i]:
            if a[0][x] in place:
                n, y = place[a[0][x]]
                mine.append((n, len(pairs)))
                pairs.append((x, y))
        kids.append(mine)
    weight, chosen = [1] * len(pairs), [[] for _ in pairs]
    for p in range(len(pairs) - 1, -1, -1):
        if kids[p]:
            chosen[p] = _in_order([(n, weight[q], q) for n, q in kids[p]])
            weight[p] = 1 + sum(weight[q] for q in chosen[p])
    out, todo = [], [0]
    while todo:
        p = todo.pop()
        i, j = pairs[p]
        out.append((i, j, a[2][i] == b[2][j]))
        todo.extend(chosen[p])
    return out


def _named(tag: str, names, inside: bool) -> bool:
    if tag in RAW or tag in AWAY or tag == "header" and not inside:
        return True
    return bool(names) and tag not in ("html", "body", "article", "main") and not NAMED.isdisjoint(names)


def _holds_content(tag: str, names) -> bool:
    return tag in ("article", "main") or tag in ("div", "section") and "main" in names


OUT, SAME = 1, 2


def roles(seed: list, counts: dict, constant: float = 0.9, most: float = 0.75) -> dict[int, int]:
    """What the wrapper says of its nodes: OUT (with all below) or SAME (the own text is template).

    ``counts``: node -> (aligned distinct trees, those with the seed's text, characters, linked characters).
    """
    n = len(seed[0])
    kids = _children(seed)
    split = [(s.split(".")[0], s.split(".")[1:]) for s in seed[0]]
    met, same, chars, links = ([counts.get(i, (0, 0, 0, 0))[k] for i in range(n)] for k in range(4))
    fixed = [met[i] > 1 and same[i] >= constant * met[i] and chars[i] > 0 for i in range(n)]
    slots = [0 if fixed[i] else chars[i] - links[i] for i in range(n)]
    headed = [t in ("h1", "h2") for t, _ in split]
    hints = {i for i, (t, names) in enumerate(split) if _holds_content(t, names)}
    body_ = set(hints) or {0}
    for i in range(1, n):
        if seed[1][i] in body_:
            body_.add(i)
    if (hints or met[0] < 5) and 2 * sum(slots[i] for i in body_) < sum(chars[i] - links[i] for i in body_):
        return {}  # most of the content is the same everywhere: copies, of which constant text says nothing
    whole = slots[:]
    for i in range(n - 1, 0, -1):
        whole[seed[1][i]] += whole[i]
        headed[seed[1][i]] |= headed[i]
    at, path, out = 0, {0}, []
    while kids[at] and at not in hints:
        top = max(kids[at], key=whole.__getitem__)
        if not whole[top] or whole[top] < most * whole[at] or not kids[top] and top not in hints:
            break
        if _named(*split[top], False):
            return {}
        out += [k for k in kids[at] if k != top and not headed[k]]
        at = top
        path.add(at)
    inside = set(path)
    for i in range(1, n):
        if seed[1][i] in inside and (seed[1][i] not in path or seed[1][i] == at):
            inside.add(i)
    if hints and not any(h in inside for h in hints):
        return {}
    found = dict.fromkeys(out, OUT)
    held = [i for i in range(n) if i in inside and not headed[i] or i in path]
    if 2 * sum(chars[i] for i in held if fixed[i]) < sum(chars[i] for i in inside):
        found.update((i, SAME) for i in held if fixed[i] and split[i][0] not in ("h1", "h2"))
    return found


def _hinted(root: Node) -> bool:
    """Whether an article or main holds text."""
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or _holds_content(x.tag, x.names)
        if inside and any(isinstance(k, str) and k.strip() for k in x.kids):
            return True
        todo.extend((k, inside) for k in x.kids if not isinstance(k, str) and k.tag not in RAW)
    return False


def _densities(root: Node) -> dict:
    """For each element its linked characters, all characters and links."""
    order, todo = [], [(root, None, False)]
    own: dict = {}
    while todo:
        x, parent, inside = todo.pop()
        inside = inside or x.tag == "a"
        size = sum(len("".join(k.split())) for k in x.kids if isinstance(k, str))
        own[id(x)] = [size if inside else 0, size, int(x.tag == "a")]
        order.append((x, parent))
        todo.extend((k, x, inside) for k in x.kids if not isinstance(k, str) and k.tag not in RAW)
    for x, parent in reversed(order):
        if parent is not None:
            up = own[id(parent)]
            for i, v in enumerate(own[id(x)]):
                up[i] += v
    return own


def main_text(html: str, wrapper: tuple[list, dict] | None = None, by_name: bool = True) -> str:
    """The page's main text; wrapper: the host's seed and its nodes' roles; by_name: judge the rest by markup."""
    if not html:
        return ""
    root = parse(html)
    gone: set = set()
    mute: set = set()
    if wrapper and wrapper[1]:
        tree, held = skeleton(root)
        for i, j, same in match(wrapper[0], tree):
            role = wrapper[1].get(i)
            if role == OUT:
                gone.update(map(id, held[j]))
            elif role == SAME and same:
                mute.update(map(id, held[j]))
    blocks: list[str] = []
    now: list[str] = []
    dense: dict = {}

    def end():
        words = " ".join("".join(now).split())
        now.clear()
        if words:
            blocks.append(words)

    def menu(k) -> bool:
        if not dense:
            dense.update(_densities(root), hinted=_hinted(root))
        linked, whole, n = dense.get(id(k), (0, 0, 0))
        return n >= 3 and linked > 0.6 * whole or dense["hinted"] and k.tag in ("ul", "ol") and 0 < linked == whole

    stack = [(iter(root.kids), False, id(root) in mute, True)]
    while stack:
        kids, inside, muted, block = stack[-1]
        k = next(kids, None)
        if k is None:
            stack.pop()
            if block:
                end()
        elif isinstance(k, str):
            if not muted:
                now.append(k)
        elif k.tag == "br":
            now.append(" ")
        elif k.tag in RAW or id(k) in gone or by_name and _named(k.tag, k.names, inside):
            if k.tag in BLOCK:
                end()
        elif k.tag in BLOCK:
            end()
            if by_name and not inside and k.tag in ("ul", "ol", "div", "table", "section") and not _holds_content(k.tag, k.names) and menu(k):
                continue
            stack.append((iter(k.kids), inside or _holds_content(k.tag, k.names), id(k) in mute, True))
        else:
            stack.append((iter(k.kids), inside, muted, False))
    return "\n".join(blocks)


def _layout(tree: list) -> str:
    """The signatures down to the children of the body."""
    depth = [0] * len(tree[0])
    out = []
    for i, p in enumerate(tree[1]):
        depth[i] = 0 if p < 0 else depth[p] + 1
        if depth[i] <= 3:
            out.append(f"{depth[i]}{tree[0][i]}")
    return " ".join(out)


def _skeletons(batches):
    import pyarrow as pa
    import xxhash

    for b in batches:
        trees, layouts = [], []
        for x in b.column("body").to_pylist():
            tree = skeleton(parse(x.decode("utf-8", "replace")))[0]
            trees.append(json.dumps(tree, ensure_ascii=False, separators=(",", ":")))
            layouts.append(xxhash.xxh3_64_intdigest(_layout(tree)) >> 1)
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("host"), pa.array(layouts, pa.int64()), pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in trees], pa.int64()), pa.array(trees, pa.string())], names=["page_id", "host", "layout", "hash", "tree"]
        )


def _aligned(batches):
    """Each batch's counts: of trees aligned with a seed's node, of those with its text, and of characters."""
    import pyarrow as pa

    for b in batches:
        sums: dict = {}
        seeds: dict = {}
        for host, raw, seed in zip(b.column("host").to_pylist(), b.column("tree").to_pylist(), b.column("seed").to_pylist()):
            if seed not in seeds:
                seeds[seed] = json.loads(seed)
            tree = json.loads(raw)
            for i, j, same in match(seeds[seed], tree):
                at = sums.setdefault((host, i), [0, 0, 0, 0])
                for k, v in enumerate((1, same, tree[3][j], tree[4][j])):
                    at[k] += v
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([int(sums[k][i]) for k in keys], pa.int64()) for i in range(4))], names=["host", "node", "met", "same", "chars", "links"]
        )


def induce(pages: DataFrame, salts: int = 32) -> DataFrame:
    """host, seed (skeleton), nodes (their counts) for hosts with two distinct trees or more. ``pages``: page_id, host, body."""
    trees = materialize(pages.mapInArrow(_skeletons, "page_id long, host string, layout long, hash long, tree string"), "trees")
    distinct = trees.groupBy("host", "layout", "hash").agg(F.min(F.struct("page_id", "tree")).alias("s"))
    layouts = distinct.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("s").alias("s"))
    seeds = layouts.groupBy("host").agg(F.sum("n").alias("n"), F.max_by("s.tree", F.struct("n", "layout")).alias("seed")).where("n > 1").select("host", "seed")
    seeds = materialize(seeds, "seeds")
    # A hot host's trees go to `salts` tasks, each with a copy of its seed.
    spread = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = distinct.select("host", F.pmod("hash", F.lit(salts)).cast("int").alias("salt"), F.col("s.tree").alias("tree"))
    counts = salted.join(spread, ["host", "salt"]).select("host", "tree", "seed").mapInArrow(_aligned, "host string, node int, met long, same long, chars long, links long")
    nodes = counts.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("met", "same", "chars", "links")))
    held = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "met", "same", "chars", "links")).alias("nodes"))  # a seed's nodes
    return seeds.join(held, "host")


def _extract(batches):
    import pyarrow as pa

    for b in batches:
        wrappers: dict = {}
        out = []
        for raw, host, seed, nodes in zip(b.column("body").to_pylist(), b.column("host").to_pylist(), b.column("seed").to_pylist(), b.column("nodes")):
            if seed is not None and host not in wrappers:
                tree = json.loads(seed)
                wrappers[host] = (tree, roles(tree, {x["node"]: (x["met"], x["same"], x["chars"], x["links"]) for x in nodes.as_py()}))
            out.append(main_text(raw.decode("utf-8", "replace"), wrappers.get(host)))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of().alias("host"), body("html").alias("body"))
    wrappers = materialize(induce(rows), "wrappers")
    return rows.join(wrappers, "host", "left").select("page_id", "url", "host", "body", "seed", "nodes").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
