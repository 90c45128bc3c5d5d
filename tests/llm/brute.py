"""Plain Python versions of the operators, for small inputs."""

import re
from collections import defaultdict
from itertools import combinations

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def judged(docs, items, width=13):
    """doc number -> (n_words, n_hit, item ids, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        n = min(width, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            windows[tuple(ws[i : i + n])].add(str(item))
    out = []
    for text in docs:
        ws, hit, found = item_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                ids = windows.get(tuple(ws[i : i + n]))
                if ids:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((len(ws), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


def kept_lines(docs, width=3):
    """(id, text) rows in order -> text with later windows cut out."""
    first, order = {}, sorted(range(len(docs)), key=lambda i: docs[i][0])
    cut = defaultdict(set)
    for i in order:
        lines = docs[i][1].split("\n")
        for at in range(len(lines) - width + 1):
            window = tuple(lines[at : at + width])
            if not any(x.strip(" \t\r\f\v") for x in window):
                continue
            if window in first:
                cut[i] |= set(range(at, at + width))
            else:
                first[window] = (i, at)
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut[i]) for i, (_, t) in enumerate(docs)]


def shingles(text, size):
    ws = space_words((text or "").translate(LOWER))
    n = min(size, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def near_groups(docs, size, percent):
    """(id, text) rows -> smallest id reachable for each."""
    sets = [shingles(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (key, _) in enumerate(docs):
        smallest[find(i)].append(key)
    return [min(smallest[find(i)]) for i in range(len(docs))]
