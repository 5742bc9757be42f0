"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def jaccard(rows, size=5):
    """id: (set size, least id of its component)."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        if len(words) >= size:
            sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
        else:
            sets[i] = {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, length, keep_first=False):
    """List of (bytes, removed, spans, digest) per row; rows in order of id."""
    texts = [(text or "").encode() for _, text in rows]
    count, first = Counter(), {}
    for n, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            count[t[s : s + length]] += 1
            first.setdefault(t[s : s + length], (n, s))
    out = []
    for n, t in enumerate(texts):
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if first[w] != (n, s) if keep_first else count[w] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    """id: (words, hit words, item ids)."""
    phrases = {}
    for item, text in items:
        words = tuple(WORD.findall(lowered(text)))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            phrases.setdefault(words[k : k + size], set()).add(str(item))
    out = {}
    for i, text in docs:
        words, hit, found = WORD.findall(lowered(text)), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(words) - size + 1):
                owners = phrases.get(tuple(words[k : k + size]))
                if owners:
                    hit |= set(range(k, k + size))
                    found |= owners
        out[i] = (len(words), len(hit), sorted(found))
    return out


def secrets(text, settings):
    """(base spans, all spans) as (start, rank, stop, kind)."""
    text = text or ""
    name = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
    base = [
        (m.start(), 0, m.end(), "assign")
        for m in re.finditer(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 8
    ]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    more = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        c = m[0]
        if re.search(settings.UUID, c) or any(a in c.lower() for a in settings.ALLOWED) or not (re.search("[0-9]", c) and re.search("[A-Za-z]", c)):
            continue
        most = settings.limit(settings.HEX_BITS if re.fullmatch("[0-9a-fA-F]+", c) else settings.MIXED_BITS)
        runs = []
        for s in range(len(c) - settings.WINDOW + 1):
            window = c[s : s + settings.WINDOW]
            if sum(settings.WEIGHT[window.count(x)] for x in set(window)) <= most:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + settings.WINDOW
                else:
                    runs.append([s, s + settings.WINDOW])
        more += [(m.start() + a, 3, m.start() + b, "entropy") for a, b in runs]
    more = [e for e in more if not any(b[0] <= e[0] and e[2] <= b[2] for b in base)]
    return sorted(base), sorted(base + more)


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in digits])):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0
