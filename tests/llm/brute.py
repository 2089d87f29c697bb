"""Plain Python versions of the operators, for small fixtures."""

import hashlib
import random
import re

sha = lambda b: hashlib.sha256(b).hexdigest()
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def order(rows):
    """Indices by id, null last, then by place."""
    return sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))


def substrings(rows, n=50):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    top = 2**63 - 1
    raw = [(top if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            least[s] = min(least.get(s, top), i)
    out = []
    for (i, b), (own, _) in zip(raw, rows):
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if least[b[p : p + n]] < i:
                gone[p : p + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((own, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def near(rows, percent):
    """(id, n_shingles, component_id) of each row, and the rows that come first in their component."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i in order(rows):
        first.setdefault(find(i), i)
    return [(r[0], len(s), rows[first[find(i)]][0]) for i, (r, s) in enumerate(zip(rows, sets))], sorted(first.values())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(rows, items, n=10):
    """(id, n_words, n_hit, items) of each row."""
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                got = windows.get(tuple(w[p : p + k]))
                if got:
                    hit |= set(range(p, p + k))
                    found |= {str(x) for x in got if x is not None}
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def lines(rows, n=3):
    """The text that is left of each row."""
    seen, gone = set(), [set() for _ in rows]
    for i in order(rows):
        parts = rows[i][1].split("\n") if rows[i][1] is not None else []
        for p in range(len(parts) - n + 1):
            w = tuple(parts[p : p + n])
            if w in seen:
                gone[i] |= set(range(p, p + n))
            seen.add(w)
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for (_, t), g in zip(rows, gone)]


def texts(seed, n=60):
    """Documents with copies, near copies, shared passages, repeated lines, nulls, empties and repeated ids."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeiounst") for _ in range(r.randint(1, 6))) for _ in range(120)] + ["É", "naïve", "中文", "Don't", "x2"]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(2, 12)))
    passage = "\n".join(line() for _ in range(4))
    rows = []
    for k in range(n):
        kind = r.random()
        text = "\n".join(line() for _ in range(r.randint(1, 8)))
        if rows and kind < 0.15:
            text = r.choice(rows)[1]
        elif rows and kind < 0.4:
            base = (r.choice(rows)[1] or "empty once").split(" ")
            base[r.randrange(len(base))] = r.choice(vocabulary)
            text = " ".join(base)
        elif kind < 0.55:
            text = text + "\n" + passage + "\n" + line()
        elif kind < 0.62:
            text = r.choice([None, "", " ", "\n\n\n\n", "word", "Ä" * 60, "ab " * 40])
        rows.append((r.choice([None, 3, k, k, k, k, k]) if k else 7, text))
    return rows
