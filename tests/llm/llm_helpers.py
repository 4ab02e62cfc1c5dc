"""Plain Python counterparts of what the operators compute."""

import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    w = WORDS((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def near_groups(docs, width=3, num=85, den=100):
    """{id: (set size, smallest linked id)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, width) for i, t in docs}
    holders, groups = defaultdict(list), Sets(sets)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, k in shared.items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def counts(text):
    t = text or ""
    w = WORDS(t)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {z for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for z in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORDS(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """{source: target} by repeated resharing; sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def repair_plainly(turns):
    """(cost, audit) of the cheapest repair of (initial, deletion forced, cut off) turns: the least pair
    for each state of the grammar, turn by turn."""
    other = {"u": "a", "a": "u"}

    def put(ways, state, way):
        ways[state] = min(ways.get(state, way), way)

    def inserted(ways):
        out, last = dict(ways), dict(ways)
        for _ in range(2):
            new = {}
            for s, (c, a) in last.items():
                put(new, "u" if s == "a" else "a", (c + 5, a + "I"))
            for s, w in new.items():
                put(out, s, w)
            last = new
        return out

    ways = {"Z": (0, "")}
    for initial, gone, cut in turns:
        new = {}
        for s, (c, a) in inserted(ways).items():
            put(new, s, (c + 2, a + "D"))
            if not gone:
                want = "a" if s == "a" else "u"
                put(new, other[want], (c + 5 * cut + (initial != want), a + ("K" if initial == want else "R")))
                if s == "Z" and initial == "s":
                    put(new, "S", (c + 5 * cut, a + "K"))
        ways = new
    ways = inserted(ways)
    return min(ways[s] for s in ("Z", "u") if s in ways)
