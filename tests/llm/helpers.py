"""Brute-force versions and hostile little tables for the operators."""

import hashlib
import math
import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def vocabulary(rng, n=60):
    return ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(seed=1, n=60):
    """(id, text) with exact and near copies, shared passages, null and empty texts, odd white space, and one long text."""
    rng = random.Random(seed)
    pool = vocabulary(rng)
    text = lambda k: "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "\t", " ", ". "]) for _ in range(k))
    rows = [text(rng.randint(0, 60)) for _ in range(n)]
    passage = text(30)
    for k in range(0, n, 7):
        rows[k] = text(5) + passage + text(9)
    for k in range(3, n, 11):
        rows[k] = rows[k - 1]
    for k in range(5, n, 13):
        own = rows[k - 2].split(" ")
        if own:
            own[len(own) // 2] = "CHANGED"
        rows[k] = " ".join(own)
    rows[8], rows[9], rows[10], rows[11] = None, "", "   \n\t ", text(3000)
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, rows))


def frame(spark, rows, source="s"):
    """Documents with the given (id, text), in the columns of ``documents`` and with extra columns of clashing names."""
    full = [(i, t, "en", source if isinstance(source, str) else source(i), len(t or "")) for i, t in rows]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(full, DOCS)
    for name in ("id", "block", "n", "size", "copies", "uid", "h", "rep", "score", "carry", "target", "class"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def window_dedup(rows, size=13):
    """{id: (words, removed, kept text)}; every row of an id compares with smaller ids only."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def byte_dedup(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def shingles(text, size=5):
    w = words(lower(text))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def classes(ids, links):
    """Smallest reachable id of each id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    return {i: len(s) for i, s in sets}, classes([i for i, _ in sets], links)


def line_statistics(text):
    w = words(text)
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), repeated, len(covered)


def fill(sizes, weights, total, most=2.0):
    """Targets by weight; those above ``most`` times their size stop there, and the rest is shared again."""
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        target = [most * s if i in capped else rest * weights[i] / sum(weights[k] for k in free) for i, s in enumerate(sizes)]
        above = {i for i in free if target[i] > most * sizes[i]}
        if not above or len(above) == len(free):
            return [min(t, most * s) for t, s in zip(target, sizes)]
        capped |= above


def systematic(rows, aims, seed="mix", most=2.0):
    """Copies of each row (id, text, source), in order: a walk along every source's line, document by document."""
    out = [0] * len(rows)
    for source, target in aims.items():
        md5 = lambda x: hashlib.md5((seed + x).encode()).hexdigest()
        line = sorted((-len(words(t)), md5("" if i is None else str(i)), k) for k, (i, t, s) in enumerate(rows) if s == source)
        left = sum(-n for n, _, _ in line)
        even, wanted = (min(target / left, most) if left else 0.0), target
        place = int(md5("" if source is None else "=" + source)[:8], 16) / 2**32
        for size in sorted({-n for n, _, _ in line}, reverse=True):
            own = [k for n, _, k in line if -n == size]
            each = min(max(wanted / left, 0.0), most) if size and left else even
            for j, k in enumerate(own):
                out[k] = math.floor(place + each * (j + 1)) - math.floor(place + each * j)
                wanted -= out[k] * size
            left -= size * len(own)
            place = (place + each * len(own)) % 1.0
    return out
