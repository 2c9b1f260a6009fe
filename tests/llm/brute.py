"""Plain versions of the numbered operators, on lists and numpy arrays."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(docs, width, percent=80):
    """{id: (n_shingles, component)} of (id, text); every pair that shares a shingle is compared."""
    sets = {i: shingles(t, width) for i, t in docs}
    classes = defaultdict(list)
    for i, s in sets.items():
        if s:
            classes[frozenset(s)].append(i)
    links, shared, holders = [], defaultdict(int), defaultdict(list)
    for same in classes.values():
        links += [(same[0], x) for x in same[1:]]
    for s, same in classes.items():
        for x in s:
            holders[x].append(same[0])
    for held in holders.values():
        for k, a in enumerate(held):
            for b in held[k + 1 :]:
                shared[a, b] += 1
    links += [(a, b) for (a, b), i in shared.items() if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i)]
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def embedding_links(rows, threshold=0.98):
    """{id: (n_links, component)} of (id, vector, label)."""
    good = [(i, np.asarray(v, float), lab) for i, v, lab in rows if usable(v) and lab is not None]
    links, count = [], defaultdict(int)
    for lab in {g[2] for g in good}:
        part = [g for g in good if g[2] == lab]
        for k, (a, x, _) in enumerate(part):
            for b, y, _ in part[k + 1 :]:
                if len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links.append((a, b))
                    count[a] += 1
                    count[b] += 1
    found = components([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], found[r[0]]) for r in rows}


def nearest(rows, every=50, k=5):
    """{query: [(id, cosine)]}, nearest first."""
    good = [(i, np.asarray(v, float)) for i, v in rows if usable(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            c = [(-(x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)), i) for i, y in good if i != q and len(x) == len(y)]
            out[q] = [(i, -s) for s, i in sorted(c)[:k]]
    return out


KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    """[(start, kind, end)] by the plain patterns."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, good in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(out)


def base_sha256(text):
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def token_ids(library, text, end=None):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids + [end] * (end is not None)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, docs, library, size=2048, end=1):
    """Rows (doc_id, start, length, crc, doc_tokens, sequence, offset) hold each id once, gapless; returns the padded share."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for d, start, n, c, total, seq, off in rows:
        pieces[d].append((start, n, c, total))
        windows[seq].append((off, n))
    assert set(pieces) == {d for d, _ in docs}
    for d, text in docs:
        ids, at = token_ids(library, text, end), 0
        for start, n, c, total in sorted(pieces[d]):
            assert (start, total, c) == (at, len(ids), crc(ids[at : at + n])) and n > 0
            at += n
        assert at == len(ids)
    padded = filled = 0
    for held in windows.values():
        at = 0
        for off, n in sorted(held):
            assert off == at
            at += n
        assert at <= size
        filled += at
        padded += size - at
    return padded / max(1, padded + filled)
