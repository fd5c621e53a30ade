"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(text):
    text = text or ""
    words = SPACED.findall(text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), sum(
        a == b for a, b in zip(words[1:], words, strict=False)
    )


def quality_kept(rows):
    """Whether each (doc_id, text, source) row is kept."""
    judged = []
    for _, text, source in rows:
        n, chars, symbols, dups, repeats, same = measures(text)
        base = n < 20 or 100 * repeats > 30 * n

        def over(short, long, many, lines, stutter):
            return 10 * chars < short * n or 10 * chars > long * n or 10 * symbols > many * n or 10 * dups > lines * n or 10 * same > stutter * n

        judged.append((source, base, base or over(30, 120, 1, 1, 1), over(20, 200, 3, 3, 3)))
    docs, bad = Counter(j[0] for j in judged), Counter(j[0] for j in judged if j[2])
    rates = [bad[s] / docs[s] for s in docs]
    mean = sum(rates) / len(rates) if rates else 0
    var = sum((r - mean) ** 2 for r in rates) / len(rates) if rates else 0
    strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1e6) if var > 0 else 1e6
    distrusted = {s: (bad[s] + mean * strength) / (docs[s] + strength) > 0.3 for s in docs}
    return [not base and not wide and not (distrusted[source] and narrow) for source, base, narrow, wide in judged]


def deduped_lines(docs):
    """{doc_id: (text, lines before, lines dropped)} of {doc_id: text}."""
    key = lambda line: line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(SMALL)
    holders = defaultdict(set)
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(doc)
    last = {k: max(d) for k, d in holders.items() if len(d) >= 5}
    out = {}
    for doc, text in docs.items():
        lines = (text or "").split("\n")
        kept = [line for line in lines if last.get(key(line), doc) == doc]
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def shingles(text):
    words = SPACED.findall((text or "").translate(SMALL))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(docs, percent=85):
    """{doc_id: smallest id reachable over links of similarity of at least so many percent}."""
    sets = {doc: shingles(text) for doc, text in docs.items()}
    root = {doc: doc for doc in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {doc: find(doc) for doc in docs}


def contained(docs, items, threshold=0.8):
    """{(doc, item): containment} at or over the threshold."""
    out = {}
    for item, text in items.items():
        words = PLAIN.findall((text or "").lower())
        width = min(5, len(words))
        if not width:
            continue
        want = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        for doc, body in docs.items():
            own = PLAIN.findall((body or "").lower())
            have = {tuple(own[i : i + width]) for i in range(len(own) - width + 1)}
            share = len(want & have) / len(want)
            if share >= threshold:
                out[doc, item] = share
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
