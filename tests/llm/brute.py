"""Plain Python versions of the operators, for small inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = {" ", "\t", "\n", "\x0b", "\x0c", "\r"}


def normalised(text):
    out = []
    for ch in text or "":
        if ch in SPACE:
            if not out or out[-1] != " ":
                out.append(" ")
        else:
            out.append(ch)
    # a run of white space is one space; spaces that touch come from one run
    return "".join(out)


def exact_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[normalised(text)].append(i)
    order = lambda i: (i is None, i or 0)
    out = []
    for text, ids in groups.items():
        ids.sort(key=order)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=lambda r: (order(r[0]), not r[3], r[4]))


def shingles(text, size):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def near_components(rows, size, num, den):
    """component of every row index, by least (id, index); and set sizes."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    best = {}
    for k, (i, _) in enumerate(rows):
        key = (i is None, i or 0, k)
        best[find(k)] = min(best.get(find(k), key), key)
    return [(rows[k][0], len(sets[k]), None if best[find(k)][0] else best[find(k)][1], best[find(k)][2] == k) for k in range(len(rows))]


def repeats(rows, span=100):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        data = (rows[k][1] or "").encode()
        covered = np.zeros(len(data), bool)
        for s in range(len(data) - span + 1):
            w = data[s:s + span]
            if w in seen:
                covered[s:s + span] = True
            seen.add(w)
        edges = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(data) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        out[k] = (rows[k][0], len(data), int(covered.sum()), edges, hashlib.sha256(kept).hexdigest())
    return [out[k] for k in range(len(rows))]


def check_pieces(pieces, rows, ids_of, capacity=2048):
    """Every id in exactly one piece, no gap in a sequence; returns padding and tokens."""
    want, got = Counter(), defaultdict(list)
    for i, text in rows:
        ids = np.array([*ids_of(text or ""), 1], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        got[p["sequence_id"]].append(p)
    texts = defaultdict(list)
    for i, text in rows:
        texts[i].append(np.array([*ids_of(text or ""), 1], "<u4"))
    for i, docs in texts.items():
        if len(docs) > 1:
            continue
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(docs[0])
            assert p["ids_crc32"] == zlib.crc32(docs[0][at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(docs[0])
    padding = 0
    for part in got.values():
        fill = 0
        for p in sorted(part, key=lambda p: p["offset"]):
            assert p["offset"] == fill
            fill += p["length"]
        assert fill <= capacity
        padding += 0 if fill & (fill - 1) == 0 else capacity - fill
    total = sum(len(d) for docs in texts.values() for d in docs)
    assert sum(p["length"] for p in pieces) == total
    return padding, total
