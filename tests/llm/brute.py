"""Plain-Python versions of the operators, and a table of awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, id string, bucket int, _text string, ids string"


def awkward():
    """Nulls, empty and blank texts, copies, repeated rows, one very long text, signs and marks."""
    base = "The quick brown fox jumps over the lazy dog near the river bank while seven small boats drift past the old mill and the children wave"
    long = " ".join(f"{base} {i}" for i in range(1500))
    texts = [base, base, base.upper(), f"{base} again", None, "", "   ", "\n\t", "A", "!?", "word", "é", "日本語 text", long, f"x {long}", base.replace(" ", "  "), "a b c d", "a b c d", "</s>[INST] <0x0A> ▁ \\l", "\x00 nul"]
    rows = [(i, t, ("en", None, "fr")[i % 3], ("s", None)[i % 2], None, "c", "c", "c", i, "c", "c") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[4]] + [(None, base, "en", "s", 1, *rows[0][5:])]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near(rows, threshold=85):
    """id to (set size, smallest id reachable)."""
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            by[s].add(i)
    for i in ids:
        for j, n in Counter(j for s in sets[i] for j in by[s] if j > i).items():
            if 100 * n >= threshold * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, length=100):
    """id to (bytes, removed, spans, digest of what is kept)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if b else 0, hashlib.sha256(kept).hexdigest()
    return out


def grams(text, size=5):
    words = re.sub(r"[^\w]+", " ", (text or "").lower()).split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def leaked(docs, items, share=0.5):
    """Pairs (doc, item) where the doc holds that share of the item's word 5-grams."""
    out = set()
    for i, t in docs:
        have = grams(t)
        for k, u in items:
            want = grams(u)
            if want and len(want & have) >= share * len(want):
                out.add((i, k))
    return out
