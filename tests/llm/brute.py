"""Plain versions of the operators, to compare with."""

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def decontaminated(docs, items, window=10):
    """docs, items: (id, text).  {doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    by_length = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            by_length[n][tuple(w[k : k + n])].add(str(item))
    out = {}
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for n, known in by_length.items():
            for k in range(len(w) - n + 1):
                if x := known.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def deduplicated(docs, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    first = {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        w = SPACE.findall(text or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), doc)
    out = {}
    for doc, text in docs:
        w = SPACE.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < doc:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_scores(docs, held_out):
    """{doc_id: (n_tokens, n_known, train_tokens, base_score)}"""
    import math
    from collections import Counter

    tokens = {d: [*SPACE.findall((t or "").translate(FOLD)), None] for d, t in docs}
    c = Counter(w for d, ws in tokens.items() if not held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()}


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    hit = {k + i for ks in places.values() if len(ks) > 1 for k in ks for i in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def shingle_sets(docs, n=5):
    out = {}
    for doc, text in docs:
        w = SPACE.findall((text or "").translate(FOLD))
        out[doc] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def near_components(docs, n=5, share=75):
    """{doc_id: (n_shingles, component_id)}, by comparing each set with all that have a shingle in common."""
    sets = shingle_sets(docs, n)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    having = defaultdict(list)
    for d in sorted(sets):
        met = defaultdict(int)
        for s in sets[d]:
            for e in having[s]:
                met[e] += 1
            having[s].append(d)
        for e, k in met.items():
            if 100 * k >= share * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}
