"""Plain restatements of what the operators compute, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_groups(rows, similarity=0.8):
    """{place: (least place of the group, number of links)} of rows of texts."""
    sets = [shingles(t) for t in rows]
    inv = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inv[x].append(i)
    up, links = list(range(len(rows))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in inv[x] if j > i).items():
            if both >= similarity * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (root(i), links[i]) for i in range(len(rows))}


def ppm(train, order):
    """A function from text to log10 probability."""
    seq = lambda t: b"\xff" * order + " ".join(words(t)).encode() + b"\xff"
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        b = seq(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k][b[i - k : i]][b[i]] += 1

    def p(b, i):
        out, gone = 1.0, set()
        for k in range(order, -1, -1):
            c = {s: n for s, n in counts[k].get(b[i - k : i], {}).items() if s not in gone}
            if not c:
                continue
            total = 2 * sum(c.values())
            if b[i] in c:
                return out * (2 * c[b[i]] - 1) / total
            out *= len(c) / total
            gone |= set(c)
        return out / (256 - len(gone))

    return lambda t: sum(math.log10(p(seq(t), i)) for i in range(order, len(seq(t))))


def unigram(train):
    c = Counter()
    for t in train:
        c.update(words(t))
        c["\n"] += 1
    n, v = sum(c.values()), len(c)

    def score(t):
        own = words(t) + ["\n"]
        return len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)

    return n, score


def fair_queue(rows, targets, key, repeats=3):
    """{place: words taken} of rows (doc_id, source, size) by serving one word after another, the source of least
    virtual time first; key gives the order within a source."""
    import heapq

    order, budget = defaultdict(list), sum(r[2] for r in rows)
    for i, r in sorted(enumerate(rows), key=lambda x: key(x[1])):
        order[r[1]] += [i] * r[2]
    taken, heap = Counter(), [(1 / t, "" if s is None else s, s, 0) for s, t in targets.items() if t and order[s]]
    heapq.heapify(heap)
    while budget and heap:
        time, name, s, n = heapq.heappop(heap)
        taken[order[s][n % len(order[s])]] += 1
        budget -= 1
        if n + 1 < repeats * len(order[s]):
            heapq.heappush(heap, ((n + 2) / targets[s], name, s, n + 1))
    return taken


TOKEN = re.compile(r"(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+")


def typed(text, units):
    """(kind or lower-cased word, lower-cased word) of the tokens of a text."""
    out = []
    for w in TOKEN.findall(text or ""):
        low = w.translate(LOWER)
        if re.fullmatch(r"[0-9.,]+", w):
            out.append((1, low))
        elif out and out[-1][0] == 1 and low in units:
            out.append((3, low))
        else:
            out.append((2 if re.match("[A-Z\u00c0-\u00d6\u00d8-\u00de]", w) else low, low))
    return out


def template_windows(t, k):
    """{window: places}: the typed tokens, or the words where fewer than two are plain."""
    out = defaultdict(list)
    for i in range(len(t) - k + 1):
        part = t[i : i + k]
        plain = sum(isinstance(x, str) for x, _ in part)
        out[(plain < 2, tuple(w if plain < 2 else x for x, w in part))].append(i)
    return out


def contaminated(text, item, units, coverage=0.5):
    """(coverage, slots, changed slots) of the item's best passage in the text, or None."""
    d, t = typed(text, units), typed(item, units)
    n, k = len(t), min(len(t), 5)
    if n < 4:
        return None
    mine = template_windows(d, k)
    hits = sorted((i, j) for w, js in template_windows(t, k).items() for j in js for i in mine.get(w, ()))
    best, reach = None, -(10**9)
    for start in sorted({i - j for i, j in hits}):
        band = [(i, j) for i, j in hits if start <= i - j <= start + max(2, n // 4)]
        if max(i - j for i, j in band) <= reach:
            continue
        reach = max(i - j for i, j in band)
        worth, before = [k] * len(band), [-1] * len(band)
        for b, (i, j) in enumerate(band):
            for a, (x, y) in enumerate(band[:b]):
                if x < i and y < j:
                    value, change = worth[a] + min(k, i - x, j - y), abs((x - y) - (i - j))
                    old = band[before[b]] if before[b] >= 0 else None
                    if value > worth[b] or old and value == worth[b] and change <= abs((old[0] - old[1]) - (i - j)):
                        worth[b], before[b] = value, a
        b, chain = max(range(len(band)), key=lambda b: (worth[b], -b)), []
        while b >= 0:
            chain.append(band[b])
            b = before[b]
        slots = {c: [(t[c[1] + x], d[c[0] + x]) for x in range(k) if not isinstance(t[c[1] + x][0], str)] for c in chain}
        votes = Counter(x for s in slots.values() for x in s)
        if any(len({y for x, y in votes if x == a}) > 1 for a, _ in votes if a[0] == 2):
            continue
        values = defaultdict(list)
        for (a, y), c in votes.items():
            values[a].append((c, a[1] == y[1], y))
        several = {a: max(v) for a, v in values.items()}
        tied = any(sum(x[:2] == several[a][:2] for x in v) > 1 for a, v in values.items())
        kept = [c for c, s in slots.items() if all(a[1] == y[1] for a, y in s) or all(several[a][2] == y for a, y in s)]
        share = len({j + x for _, j in kept for x in range(k)}) / n
        if share >= coverage and (best is None or share > best[0]):
            pairs = {x for c in kept for x in slots[c]}
            best = (share, len(pairs), sum(a[1] != y[1] for a, y in pairs), tied)
    return best


def _mix64(h):
    for _ in range(2):
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) % 2**64
    return h ^ (h >> 32)


class Fingerprints:
    """Digests of texts by the corpus' histogram of window entropies: windows of 64 bytes, votes of 16, 5 bits a feature
    in filters of 2,048 bits with 160 features."""

    def __init__(self, corpus):
        n = Counter(x for t in corpus for x in self.bins((t or "").encode()))
        order = sorted(range(1001), key=lambda i: (i < 100, n[i], i))
        self.rank = {x: i for i, x in enumerate(order)}

    @staticmethod
    def bins(b):
        cost = lambda c: round((1 << 16) * c * math.log2(c)) if c else 0
        full = 6 * 64 << 16
        return [(full - sum(cost(c) for c in Counter(b[i : i + 64]).values())) * 1000 // full for i in range(len(b) - 63)]

    def filters(self, text):
        b = (text or "").encode()
        keys = [(self.rank[x], i) for i, x in enumerate(self.bins(b))]
        votes = Counter(min(keys[j : j + 64])[1] for j in range(len(keys) - 63))
        at = sorted(i for i, n in votes.items() if n >= 16)
        if keys and not at:
            at = [min(keys)[1]]
        parts = [b[i : i + 64] for i in at] or ([b] if b else [])
        base, out = 0x9E3779B97F4A7C15, []
        for p in parts:
            h, power = 0, 1
            for x in p:
                power = power * base % 2**64
                h = (h + (x + 1) * power) % 2**64
            out.append(_mix64(h))
        chain = [out[i : i + 160] for i in range(0, len(out), 160)]
        return len(out), [{(h >> 11 * j) & 2047 for h in part for j in range(5)} for part in chain]

    def string(self, text):
        import base64

        n, chain = self.filters(text)
        bits = b"".join(int("".join("1" if i in f else "0" for i in range(2048)), 2).to_bytes(256, "big") for f in chain)
        return f"{n}:{base64.b64encode(bits).decode()}" if chain else ""

    def likeness(self, a, b):
        x, y = self.filters(a)[1], self.filters(b)[1]
        if not x or not y:
            return float(x == y)
        if len(x) > len(y):
            x, y = y, x

        def two(f, g):
            chance = len(f) * len(g) / 2048
            return min(1.0, max(0.0, (len(f & g) - chance) / max(min(len(f), len(g)) - chance, 1e-9)))

        return sum(max(two(f, g) for g in y) for f in x) / len(x)
