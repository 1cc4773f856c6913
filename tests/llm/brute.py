"""Plain restatements of the registered queries, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash


def sha(data):
    return hashlib.sha256(data).hexdigest()


def contaminated(docs, items, window=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}
    words = lambda t: word.findall((t or "").translate(lower))
    strings = defaultdict(set)
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1) if m else ():
            strings[tuple(w[i:i + m])].add(item)
    sizes = sorted({len(s) for s in strings})
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                ids = strings.get(tuple(w[i:i + m]))
                if ids:
                    hit.update(range(i, i + m))
                    found |= ids
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), sha(",".join(ids).encode()), bool(hit)))
    return out


def _removed(sequences, window):
    """Per sequence, a flag for each unit that a repeated window covers."""
    seen = Counter(bytes(s[i:i + window]) if isinstance(s, bytes) else tuple(s[i:i + window])
                   for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone, until = [False] * len(s), 0
        for i in range(len(s)):
            key = bytes(s[i:i + window]) if isinstance(s, bytes) else tuple(s[i:i + window])
            if i + window <= len(s) and seen[key] > 1:
                until = i + window
            gone[i] = i < until
        out.append(gone)
    return out


def dedup_bytes(docs, window=400):
    texts = [(t or "").encode() for _, t in docs]
    out = []
    for (doc, _), text, gone in zip(docs, texts, _removed(texts, window)):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((doc, len(text), sum(gone), spans, sha(kept)))
    return out


def dedup_words(docs, window=35):
    texts = [(t or "").encode().split() for _, t in docs]
    return [
        (doc, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
        for (doc, _), w, gone in zip(docs, texts, _removed(texts, window))
    ]


def quality(docs):
    out = []
    for doc, text in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        covered = set()
        for i in range(len(words) - 4):
            if seen[tuple(words[i:i + 5])] > 1:
                covered.update(range(i, i + 5))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((
            doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed,
        ))
    return out


def near_duplicates(docs, size=4, percent=80):
    sets = {}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets[doc] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
    owners = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            owners[x].append(doc)
    both = Counter()
    for group in owners.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                both[a, b] += 1
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return [(d, len(s), root(d), root(d) == d) for d, s in sets.items()]


def token_rows(docs, tokenizer, end_id=2):
    out, start = [], 0
    for doc, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def sim_hash(docs, radius=2):
    prints = {}
    for doc, text in docs:
        w = (text or "").encode().lower().split()
        k = min(3, len(w))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)] if k else []
        prints[doc] = sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
    return [(d, "%016x" % prints[d], c) for d, c in nearest(prints, radius).items()]


def nearest(prints, radius):
    """Least id that links of at most ``radius`` differing bits lead to, by all pairs."""
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in prints.items():
        for b, y in prints.items():
            if (x ^ y).bit_count() <= radius:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in prints}


def variant_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def variants(words):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    about = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in about.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(about[w]), words.get(form[w])) for w, n in words.items()]
