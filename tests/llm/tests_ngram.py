"""Brute force for the n-gram join."""

from __future__ import annotations

import re


def sets_of(rows):
    out = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, percent=75):
    sets = sets_of(rows)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, len(s), (least.get(g) if s else d)) for g, s, (d, _) in zip(group, sets, rows, strict=True)), key=str)
