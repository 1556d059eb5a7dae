"""The contracts of the queries, computed the plain way, one text after the other."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK = "\x20\t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


#: All null ids count as one, the largest there is.
LAST = (1 << 63) - 1


def place(i):
    return LAST if i is None else i


def lines(docs):
    """op1 over [(id, text)]: {id: (n_lines, n_dropped, sha)}; ids are unique."""
    return {i: x for (i, _), x in zip(docs, line_rows(docs), strict=True)}


def line_rows(docs):
    """op1 over [(id, text)], a result a row; rows that share an id are one document."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(place(i))
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 10 or min(holders[key(x)]) == place(i)]
        out.append((len(parts), len(parts) - len(kept), sha("\n".join(kept))))
    return out


def counts(text):
    """op2: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = set()
    for i in range(len(words) - 2):
        if runs[tuple(words[i : i + 3])] > 1:
            held.update((i, i + 1, i + 2))
    n = len(words)
    failed = n < 50 or 100 * len(held) > 50 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(held), failed


def substrings(docs, length=50):
    """op5 over [(id, text)]: {id: (n_bytes, n_removed, n_spans, sha)}; ids are unique."""
    return {i: x for (i, _), x in zip(docs, substring_rows(docs, length), strict=True)}


def substring_rows(docs, length=50):
    """op5 over [(id, text)], a result a row; rows that share an id are one document."""
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, LAST), place(i))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < place(i):
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        out.append((len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha(kept)))
    return out


def fingerprint(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs):
    """op9 over [(id, text)]: {id: (fingerprint, component)}."""
    fps = {i: fingerprint(t) for i, t in docs}
    least = {}
    for i, f in fps.items():
        least[f] = min(least.get(f, i), i)
    distinct = np.array(sorted(least), np.uint64)
    root = {int(f): int(f) for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, f in enumerate(distinct):
        for g in distinct[n + 1 :][np.bitwise_count(distinct[n + 1 :] ^ f) <= 2]:
            a, b = find(int(f)), find(int(g))
            root[max(a, b)] = min(a, b)
    names = {}
    for f in map(int, distinct):
        r = find(f)
        names[r] = min(names.get(r, least[f]), least[f])
    return {i: (f"{f:016x}", names[find(f)]) for i, f in fps.items()}


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, (3, 1, 2) * len(order)))
    cap = {s: 2 * sizes[s] for s in order}
    out, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if total and left * weight[s] / total > cap[s] + 1e-9}
        if not over:
            break
        for s in over:
            out[s] = float(cap[s])
            left -= cap[s]
        open_ -= over
    for s in open_:
        out[s] = left * weight[s] / sum(weight[x] for x in open_)
    return out


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url(value):
    """op7: (host, path, rule, verdict or None)."""
    host = path = ""
    if value and "://" in value:
        rest = value.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, None
    best = max(fits, key=lambda r: len(r[0]) + len(r[1]))
    return host, path, best[0] + best[1], best[2]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    """op10: (n_assign, n_access, n_hex, base_sha256)."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    found.sort(key=lambda s: (s[1], order.index(s[0])))
    n = Counter(k for k, _, _ in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))


def pieces(docs, rows, encode, window=4096):
    """op3: problems of rows (id, start, length, crc, doc_tokens, sequence, offset) against [(id, text)]."""
    ids = {i: np.array(encode(t or "") + [2], "<u4") for i, t in docs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for i, start, length, crc, tokens, sequence, offset in rows:
        by_doc[i].append((start, length))
        by_sequence[sequence].append((offset, length))
        if tokens != len(ids[i]) or length < 1 or crc != zlib.crc32(ids[i][start : start + length].tobytes()):
            return f"document {i}: piece at {start}"
    if set(by_doc) != set(ids):
        return "documents differ"
    for i, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            if start != at:
                return f"document {i}: gap at {at}"
            at += length
        if at != len(ids[i]):
            return f"document {i}: ends at {at}"
    padding = 0
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            if offset != at:
                return f"sequence {s}: gap at {at}"
            at += length
        if at > window:
            return f"sequence {s}: {at}"
        padding += 0 if at & (at - 1) == 0 else window - at
    total = sum(map(len, ids.values()))
    return None if padding <= 0.01 * total else f"padding {padding} of {total}"
