"""Awkward tables and plain versions of the operators' rules."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=("the of and to in is that for it was on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part").split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def awkward_rows():
    long = "\n".join(prose(k, 40) + "." for k in range(400))
    near = prose(3, 120)
    edited = near.split()
    edited[60] = "changed"
    return [
        (0, None, "en", "a", None), (1, "", "en", None, 0), (2, " \n\t ", None, "a", 3), (3, near, "en", "a", 9), (4, near, "en", "b", 9), (5, " ".join(edited), "en", "a", 9),
        (6, long, "en", "a", 1), (7, long + " tail", None, "a", 1), (8, "one two", "en", "b", 7), (9, "one  two", "en", "b", 8), (10, "é😀\x85\u2028ß " * 30, "fr", "b", 5), (11, "aaaa" * 500, "fr", "a", 4),
        (12, "ab" * 400, None, None, 4), (13, near, "en", "a", 9), (None, prose(9, 30), "fr", "a", 1), (14, "12345 !!! ###", "fr", "a", 1), (15, "a | b | c | d | e | f | g | h | i | j | k\n" * 3, "fr", "b", 1),
    ]


def awkward(spark, extra=True):
    df = spark.createDataFrame(awkward_rows(), DOCS)
    if not extra:
        return df
    from pyspark.sql import functions as F

    # names that operators use themselves
    for c in ("score", "kept", "topic", "probability", "text_key", "chunk", "bucket", "class_id", "root", "u", "v", "n_tokens", "drawn", "bands"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def shingle_set(text, k=5):
    w = WORD.findall(text or "")
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def plain_classes(rows, t=0.8):
    """doc_id: (text_id, class_id, n_links) by all pairs."""
    first = {}
    for i, text in sorted(rows):
        first.setdefault(text or "", i)
    ids = {i: shingle_set(x) for x, i in first.items()}
    links = {i: {j for j in ids if j != i and ids[i] and ids[j] and len(ids[i] & ids[j]) >= t * len(ids[i] | ids[j]) - 1e-9} for i in ids}
    root = {}
    for i in sorted(ids):
        todo = [i] if i not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (first[x or ""], root[first[x or ""]], len(links[first[x or ""]])) for i, x in rows}


def plain_spans(rows, span=50):
    """doc_id: (n_bytes, n_removed, n_spans, sha256) one string after the other."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        own = [b[k : k + span] for k in range(len(b) - span + 1)]
        gone = [False] * len(b)
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + span] = [True] * span
        seen.update(own)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
    return out


def plain_quality(text):
    w = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for k in range(len(w) - 4):
        at.setdefault(tuple(w[k : k + 5]), []).append(k)
    hit = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)
