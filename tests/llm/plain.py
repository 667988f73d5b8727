"""Plain versions of the corpus operators, for small tables."""

import math
import random
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spans(patterns, text, valid):
    found = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if valid(kind, m):
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def shingle_set(text, size):
    w = words(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_components(texts, size, percent):
    """Smallest reachable id per id, by comparing all pairs."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    return {i: find(i) for i in ids}


def distance_in(pattern, text):
    """Smallest edit distance of the pattern to any part of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for char in text:
        last = row
        row = [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (p != char)))
        best = min(best, row[-1])
    return best


def repeat_words(w):
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({p + k for at in seen.values() if len(at) > 1 for p in at for k in range(3)})


def entropy(chars):
    return -sum(chars.count(c) / len(chars) * math.log2(chars.count(c) / len(chars)) for c in set(chars))


SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n))
