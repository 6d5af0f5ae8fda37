"""Plain Python versions of the corpus operators, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(words, n):
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def kept_words(texts, window):
    """For each text: its words, and those left when repeated windows go."""
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for k, own in enumerate(words):
        for i in range(len(own) - window + 1):
            seen.setdefault(tuple(own[i : i + window]), []).append((k, i))
    gone = {(k, j) for at in seen.values() if len(at) > 1 for k, i in at for j in range(i, i + window)}
    return [(own, [w for j, w in enumerate(own) if (k, j) not in gone]) for k, own in enumerate(words)]


def groups(docs, n, percent):
    """{id: (set size, least id reachable)} of (id, text) with distinct ids."""
    sets = {i: shingles(WORD.findall(low(t)), n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i in sorted(sets):
        near = {j for s in sets[i] for j in holders.get(s, ())}
        for j in near:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def contained(docs, items, width=5, percent=80):
    out = set()
    for i, t in docs:
        words = PLAIN.findall(low(t))
        sets = {}
        for item, text in items:
            own = PLAIN.findall(low(text))
            w = min(width, len(own))
            if not w:
                continue
            if w not in sets:
                sets[w] = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)}
            mine = shingles(own, w)
            both = len(mine & sets[w])
            if both and 100 * both >= percent * len(mine):
                out.add((i, item, len(mine), both))
    return out
