"""Plain versions of the contracts, a document at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint_text(docs):
    """doc_id -> edited text."""
    order = sorted(docs, key=lambda d: (d[0], d[1] or ""), reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[i] = t[: len(t) - half] + nxt[:half]
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def rules(text):
    b = text.encode()
    w = WORD.findall(b)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(tri)
    rep = {j for i, t in enumerate(tri) if times[t] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line.encode()):
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), dup, len(rep)


def substrings(docs, n=400):
    where = defaultdict(int)
    raw = [(t or "").encode() for t in docs]
    for b in raw:
        for i in range(len(b) - n + 1):
            where[hashlib.blake2b(b[i : i + n], digest_size=12).digest()] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if where[hashlib.blake2b(b[i : i + n], digest_size=12).digest()] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def term_ids(b):
    """The 32-bit names of the terms of a text."""
    import numpy as np

    from turnfold.llm import bytesnp as B

    low = b.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    out = set()
    for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", low)):
        out.add(int(B.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), np.ones(256, bool)).hash[0] >> np.uint64(32)))
    return out


def shingles(text, width=2):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def near(docs, width=2):
    """[(doc_id, n_shingles, component_id, kept)] by comparing all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= 80 * (len(a) + len(b) - c):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs)]


def distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def within_one(a, b):
    """Whether two lines are at an edit distance of 1 at most, by what follows their common beginning."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def repeated_strings_of_words(texts, n):
    """Whether each text holds a string of n words that also starts elsewhere."""
    split = [re.findall("[^ \t-\r]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    return [any(seen[tuple(w[i : i + n])] > 1 for i in range(len(w) - n + 1)) for w in split]
