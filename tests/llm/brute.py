"""Plain versions of what the operators must return."""

from __future__ import annotations

import re


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return set()
    k = min(k, len(w))
    return {(k, *w[i:i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(docs, k, num, den):
    """{doc_id: (set sizes, component)} of (doc_id, text) rows."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    tried = set()
    for rows in where.values():
        for j, b in enumerate(rows):
            for a in rows[:j]:
                if (a, b) in tried:
                    continue
                tried.add((a, b))
                (p, s), (q, t) = sets[a], sets[b]
                if p is None or q is None:
                    continue
                both = len(s & t)
                if den * both >= num * (len(s) + len(t) - both):
                    x, y = find(p), find(q)
                    root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal_spans(text):
    """(start, kind number, end, kind) of the fixed forms."""
    out = []
    for place, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (
                    14 <= len(digits) <= 19 and _luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), place, m.end(), kind))
    return sorted(out)
