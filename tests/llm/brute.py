"""Plain Python statements of the contracts, to hold the operators' rows against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def digest(spans, kinds):
    text = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return hashlib.sha256(text.encode()).hexdigest()


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return out


def rules(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    repeated, n_words = len(covered), len(w)
    return {
        "n_words": n_words,
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": n_words < 50 or 100 * repeated > 50 * n_words,
    }


def licences(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hits = sorted((i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return {"n_words": len(w), "n_base": len(hits), "first_word": hits[0][0] if hits else None, "last_word": hits[-1][0] if hits else None, "base_labels": ",".join(sorted({x for _, x in hits}))}


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def components(rows, links):
    """(id, ...) and pairs of ids: smallest id of each component."""
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in rows}


def jaccard_components(texts):
    """{id: text} -> {id: (set size, component)}; all pairs, by an index of shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    where: dict = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    links = []
    for i, s in sets.items():
        shared = Counter(j for g in s for j in where[g] if j < i)
        links += [(i, j) for j, n in shared.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    comp = components(list(texts), links)
    return {i: (len(sets[i]), comp[i]) for i in texts}


def mix_targets(sizes):
    """{source: size} -> {source: target}, by resharing until none is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2.0 * n for s, n in sizes.items()}
    full: set = set()
    total = 1.5 * sum(sizes.values())
    while True:
        left = total - sum(cap[s] for s in full)
        free = [s for s in sizes if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > cap[s]}
        if not above:
            return {s: cap[s] if s in full else share[s] for s in sizes}
        full |= above


def best_fit(counts, capacity):
    """Sequences that best fit opens, longest pieces first."""
    gaps: list = []
    for length in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


def without_boilerplate(rows, ratio, margin, spare):
    """[(host, text)] -> the texts without the lines that stand on too many pages of their host."""
    pages = Counter(h for h, _ in rows)
    seen = Counter((h, x) for h, t in rows for x in set((t or "").split("\n")) if words(x))
    over = lambda h, x: seen[h, x] > ratio * pages[h] + margin * (ratio * pages[h]) ** 0.5 + spare
    return [None if t is None else "\n".join(x for x in t.split("\n") if not (words(x) and over(h, x))) for h, t in rows]
