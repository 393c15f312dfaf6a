"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def flags(spans, n):
    out = [False] * n
    for a, b in spans:
        out[a:b] = [True] * (b - a)
    return out


def suffix(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = flags([(i, i + length) for i in range(len(d) - length + 1) if count[d[i : i + length]] > 1], len(d))
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = SPACED.findall(fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    """doc_id: component_id, over (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def contaminated(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(fold(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = ALNUM.findall(fold(t))
        found = [(k, k + n, windows[tuple(w[k : k + n])]) for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows]
        hit = sum(flags([f[:2] for f in found], len(w)))
        names = sorted({str(i) for f in found for i in f[2] if i is not None})
        out.append((len(w), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= len(w)))
    return out


def measures(text):
    t = text or ""
    w, lines = SPACED.findall(t), [x for x in t.split("\n") if SPACED.search(x)]
    g = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(g)
    repeat = sum(flags([(i, i + 8) for i, x in enumerate(g) if c[x] > 1], len(w)))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w))


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def lines(rows, least=32):
    """doc_id: (equal, near) over (doc_id, text) in order."""
    seen, out = [], {}
    for i, t in rows:
        equal = near = 0
        for x in (t or "").split("\n"):
            if len(x) >= least:
                if x in seen:
                    equal += 1
                    continue
                near += any(within_one(x, y) for y in seen)
                seen.append(x)
        out[i] = (equal, near)
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def lines_within(rows, edits=4, least=32):
    """doc_id: (equal, near) over (doc_id, text) in order; the bound grows with the shorter line."""
    seen, out = [], {}
    for i, t in rows:
        equal = near = 0
        for x in (t or "").split("\n"):
            if not SPACED.search(x):
                continue
            if x in seen:
                equal += 1
                continue
            allowed = lambda y: min(edits, sum(min(len(x), len(y)) >= n for n in (0, 64, 128, 256)))  # noqa: E731, B023
            near += len(x) >= least and any(len(y) >= least and abs(len(x) - len(y)) <= allowed(y) and edit_distance(x, y) <= allowed(y) for y in seen)
            seen.append(x)
        out[i] = (equal, near)
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """source: target, over source: size; None is last."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    got, rest, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        level = rest / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return got | {s: level * w[s] for s in open_}
        for s in full:
            got[s] = most * sizes[s]
            rest -= got[s]
        open_ -= full
    return got


def corpus(seed=7):
    """Texts with copies, near copies, shared passages, repeats, odd characters, and none at all."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéf") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(70), prose(120).split()
    out = [None, "", " \n\t", "one", "One two", "aa " * 400, "x" * 700, "ab" * 300, passage, passage.upper(), "é" * 150]
    for _ in range(6):
        near = list(base)
        for _ in range(r.randint(0, 3)):
            near[r.randrange(len(near))] = word()
        out.append(" ".join(near))
    out += [f"{prose(r.randint(5, 200))}\n{passage}\n{prose(30)}" for _ in range(5)]
    out += [prose(r.randint(1, 60)) for _ in range(8)]
    out += [out[-1], out[-1], out[12], prose(9000)]
    line = prose(12)
    out += [f"{line}\n{line}\n{line[:-1]}", line + "x\n" + prose(10), "a | b # c $ % & * < > " * 9]
    return out


def main_texts(pages, read, names=True):
    """id: (text, blocks cut, blocks that the tree cuts) over (id, host, html), with a plain style tree. read: html to a Page."""
    every = {i: (h, read(s or "")) for i, h, s in pages}

    def trees(host_of):
        held, looks, blocks = defaultdict(set), defaultdict(Counter), defaultdict(set)
        for i, (h, p) in every.items():
            if h is None:
                continue
            h = host_of(h)
            for path, *_ in p.nodes[1:]:
                held[h, path].add(i)
            for (k, look), c in p.layouts.items():
                looks[h, p.nodes[k][0]][look] += c
            for k, text in p.blocks:
                blocks[h, p.nodes[k][0], text].add(i)
        worth = defaultdict(dict)
        for (h, path, text), found in blocks.items():
            worth[h, path][text] = 1 - math.log(len(found)) / math.log(max(2, len(held[h, path]))) if path else 1
        below = defaultdict(set)
        for h, p in every.values():
            if h is not None:
                for k in {k for k, _ in p.blocks}:
                    for a in p.above(k):
                        below[host_of(h), a].add(p.nodes[k][0])
        out = {}
        for (h, path), found in held.items():
            inside = [w for q in below[h, path] for w in worth[h, q].values()]
            if inside:
                c, total = looks[h, path], sum(looks[h, path].values())
                look = None if not total else 1 if total == 1 else -sum(n / total * math.log(n / total) for n in c.values()) / math.log(total)
                mean = sum(inside) / len(inside)
                out[h, path] = (len(found), mean if look is None else 0.1 * look + 0.9 * mean)
        return out, held, blocks

    own, held, blocks = trees(lambda h: h)
    usual, _, _ = trees(lambda h: "")
    share = defaultdict(float)
    for h, p in every.values():
        for (path, *_), size in zip(p.nodes, p.sizes(), strict=True):
            share[h, path] += size / max(1, p.sizes()[0])
    out = {}
    for i, (h, p) in every.items():
        known, sizes = {}, p.sizes()
        for path, _, told, _ in p.nodes[1:]:
            if (h, path) in own:
                m, t = own[h, path]
                n, u = usual["", path]
                w = (m * t + 50 * (n * u + 8) / (n + 8)) / (m + 50)
                spared = told >= 2 and w >= 0.9 and m >= 8 and share[h, path] >= m / 2
                known[path] = "spared" if spared else "least" if w < 0.1 else "low" if w < 0.7 else None
        cut = []
        total = sizes[0] - sum(sizes[k] for k, x in enumerate(p.nodes) if x[2] == 3 and p.nodes[x[1]][2] != 3)
        for path, up, told, holds in p.nodes:
            said = known.get(path)
            name = told >= 2 and said != "spared" and (told == 3 or not (holds or 10 * sizes[len(cut)] >= 9 * max(total, 1)))
            tree = (said == "least" or said == "low" and told != 1) and not holds
            cut.append((name or cut[up][0], tree or cut[up][1]) if cut else (False, False))
        left = [x for x in p.blocks if not (names and cut[x[0]][0])]
        kept = [x for x in left if not cut[x[0]][1]]

        def stale(node, text, p=p, h=h):
            n, m = len(blocks[h, p.nodes[node][0], text]), len(held[h, p.nodes[node][0]])
            return p.nodes[node][2] != 1 and n > 36 and (m * (1 - math.log(n) / math.log(m)) + 4) / (m + 4) < 0.1

        if h is not None:
            kept = [x for x in kept if not stale(*x)] or kept
        kept = kept or left
        out[i] = ("\n".join(t for _, t in kept), len(p.blocks) - len(kept), sum(cut[k][1] for k, _ in p.blocks))
    return out


def pseudo_likelihood(texts, net, count, others, lm):
    """(tokens, log-probability, tokens recalled) of each list of words. net, lm: the weights, and the constants and hashes."""

    def hashes(w):
        return next(lm.words([" ".join(w).encode()], lm.SPACED))[1].hashes

    def dot(a, b):
        return sum(float(x) * float(y) for x, y in zip(a, b, strict=True))

    def chances(z):
        top = max(z)
        total = sum(math.exp(x - top) for x in z)
        return [math.exp(x - top) / total for x in z]

    known = dict(zip(net.known.tolist(), net.number.tolist(), strict=True))
    size, starts, seen, cells, out = len(known), net.starts.tolist(), Counter(), Counter(), []
    each = []
    for w in texts:
        h = [int(x) for x in hashes(w)] if w else []
        keys = lm.window_keys(lm.np.array(h, lm.U), lm.np.array([0, len(h)])).tolist() if w else []
        padded = ["", "", *w, "", ""]
        each.append((h, keys, [(*padded[k : k + 2], *padded[k + 3 : k + 5]) for k in range(len(w))]))
        for k, key in enumerate(keys):
            if key % lm.MEMORY == 0:
                seen[each[-1][2][k]] += 1
                cells[each[-1][2][k], h[k]] += 1
    for h, keys, around in each:
        number = [size + 1] * 2 + [known.get(x, size) for x in h] + [size + 1] * 2
        total, hits = 0.0, 0
        for k, x in enumerate(h):
            window = [float(v) for j in (k, k + 1, k + 3, k + 4) for v in net.embed[number[j]]]
            units = [math.tanh(dot(window, net.hidden[:-1, j]) + float(net.hidden[-1, j])) for j in range(lm.WIDTH)]
            by = chances([dot(units, net.classes[:-1, j]) + float(net.classes[-1, j]) for j in range(len(starts))])
            if x in known:
                c = max(j for j, a in enumerate(starts[:-1]) if a <= known[x])
                p = by[c] * chances([dot(units, net.members[j, :-1]) + float(net.members[j, -1]) for j in range(starts[c], starts[c + 1])])[known[x] - starts[c]]
            else:
                p = by[-1] * count[int(lm.np.uint64(x).astype(lm.np.int64))] / others
            if keys[k] % lm.MEMORY == 0:
                n, c = seen[around[k]] - 1, cells[around[k], x] - 1
                p, hits = (p * lm.KAPPA + c) / (n + lm.KAPPA), hits + (c > 0)
            total += math.log(p)
        out.append((len(h), total, hits))
    return out


def licences(text, m, lib):
    """(families, licence lines, unknown lines) of a text whose paragraphs are single lines. m, lib: the model and its constants."""
    families, known, unknown = set(), 0, 0
    for line in text.split("\n\n"):
        words = lib.tokens(line)
        if not set(words) & set(m["lexicon"]):
            continue
        mine = lib.grams(words)
        z = [(b + sum(m["weights"][g][k] for g in mine if g in m["weights"])) / m["temperature"] for k, b in enumerate(m["bias"])]
        total = sum(math.exp(x) for x in z)
        p = [math.exp(x) / total for x in z]
        best = max(range(1, len(p)), key=lambda k: p[k])
        held = max((len(mine & set(pairs)) / len(pairs) for f, _, pairs in m["templates"] if f == m["labels"][best] and pairs), default=0)
        if p[0] >= m["none"]:
            continue
        if p[best] >= m["sure"] and held >= lib.CONFIRM:
            families.add(m["labels"][best])
            known += 1
        else:
            unknown += 1
    return ",".join(sorted(families)), known, unknown
