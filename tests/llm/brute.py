"""Brute-force versions that the operators are tested against."""

from collections import Counter, defaultdict


def shingle_set(text, k=5):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(rows, num, den):
    """{id: (n_shingles, component)} over (id, text) with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    both, u = Counter(), Union()
    for ids in at.values():
        for a in range(len(ids)):
            for b in range(a):
                both[min(ids[a], ids[b]), max(ids[a], ids[b])] += 1
    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def repeats(texts, m):
    """For each text the flags of bytes covered by an m-byte string that also starts elsewhere."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = Counter(r[i : i + m] for r in raw for i in range(len(r) - m + 1))
    out = []
    for r in raw:
        flag = [False] * len(r)
        for i in range(len(r) - m + 1):
            if n[r[i : i + m]] > 1:
                for j in range(i, i + m):
                    flag[j] = True
        out.append(flag)
    return raw, out
