"""Plain versions of the corpus operators' definitions, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(A_Z)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_scores(docs):
    """op1: (doc_id, held_out, n_tokens, n_known, N, base)."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = lambda t: [*SPACE.findall(lower(t)), "\n"]
    c = Counter(x for d, t in docs if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(k := tokens(t)), sum(c[x] > 0 for x in k), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in k)) for d, t in docs]


def leaks(docs, items, n=10):
    """op2 rows."""
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        if i is not None and w:
            for k in range(max(1, len(w) - n + 1)):
                wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if ids := wins.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_path(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :])[0]
    host, slash, path = rest.partition("/")
    return host.translate(A_Z), slash + path


def rule_of(host, path):
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def base_quality(text):
    """op4: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def targets(sizes, share=1.5):
    """op5: source -> target, for (source, size) of every source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]] if total else []
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            free.remove(s)
        left = share * sum(sizes.values()) - sum(out.values())


def removed(docs, n=20):
    """op9: (doc_id, n_words, n_removed, sha) of (doc_id, text)."""
    words = [(d, [x for x in SPACE.findall(t or "")]) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < (d, i) for k in range(n)}
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def near(docs, n=2, percent=80):
    """op10: (doc_id, n_shingles, component_id, kept)."""
    sets = {}
    for d, t in docs:
        w = SPACE.findall(lower(t))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 10 * min(len(x), len(y)) >= 8 * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def merkle(docs, fanout=8):
    """op11 rows of (doc_id, source, lang, n_chars, text)."""
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(coded, r)))
    tampered = lambda r: (*r[:4], None if r[4] is None else lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r

    def grow(nodes):
        """The one node left, and of each of the first ones its runs' (slot, members) up to it."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
            for k, a in enumerate(at):
                ways[k].append((a % fanout, runs[a // fanout]))
                at[k] = a // fanout
            nodes = [sha("".join(r)) for r in runs]
        return nodes[0], ways

    def first_null(x):
        return (x is not None, x)

    langs, below = sorted({r[2] for r in docs}, key=lambda x: (x is not None, (x or "").encode())), {}
    for x in langs:
        rows = sorted((r for r in docs if r[2] == x), key=lambda r: (first_null(r[0]), leaf(r)))
        below[x] = rows, *grow([leaf(r) for r in rows])
    if not docs:
        return []
    root, upper = grow([below[x][1] for x in langs])
    out = []
    for x, more in zip(langs, upper, strict=True):
        rows, subroot, ways = below[x]
        for r, way in zip(rows, ways, strict=True):
            h, beside = leaf(tampered(r)), ""
            for slot, run in way + more:
                beside += "".join(run[:slot] + run[slot + 1 :])
                h = sha("".join([*run[:slot], h, *run[slot + 1 :]]))
            out.append((r[0], leaf(r), subroot, root, sha(beside), h, h == root))
    return out


def resampled(docs, target, n=1, buckets=10000, least=20, percent=10, seed=2024):
    """op12: (doc_id, n_words, n_features, weight, score, rank)."""
    from math import floor, log

    def features(t):
        w = WORD.findall(lower(t))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: floor(1000 * log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in s}
    out = []
    for d, x in docs:
        f, h = features(x), int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, len(WORD.findall(lower(x))), len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = fit[: len(fit) * percent // 100]
    rest = list((Counter(out) - Counter(drawn)).elements())
    return [(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest]
