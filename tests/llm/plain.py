"""Plain single-process versions of the contracts, to compare the Spark operators with."""
import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def line_dedup(docs):
    """docs: list of (doc_id, text) with distinct ids."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def simhash(text, shingle=3):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(fps, distance=2):
    """fps: list of (id, fingerprint); id -> least id of its class."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.array([f for _, f in fps], dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= distance):
            parent[root(i)] = root(int(j))
    least = {}
    for i, (d, _) in enumerate(fps):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(fps)}


def archive(pages):
    last = {}
    for i, h in pages:
        last[h or ""] = max(last.get(h or "", i), i)
    out = {}
    for i, h in pages:
        data = (h or "").encode()
        target = last[h or ""]
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                  "response" if target == i else "revisit", None if target == i else target)
    return out


def token_rows(docs, encode, end_id=1):
    start, out = 0, {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        ids = [*encode(t or ""), end_id]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    return out


def edited_texts(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = (len(t), t[:len(t) - cut] + following[:cut], following)
    return out


def ranked(docs, items, k=10):
    """docs: (id or None, text); items: (id, text); (item, rank, doc, score) of the best k."""
    import math
    from collections import Counter

    def terms(text):
        return re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").translate(LOWER))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, words in wanted.items():
        scores = []
        for i, b, size in bags:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m))
                    for t in words if t in b)
            if s > 0:
                scores.append((-s, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1:] == a for p in range(len(b)))


def spelling(docs, min_chars=5, min_count=3, ratio=2, noise=97):
    """(word, form, root, n, n_near, form_n) by comparing all words with all words."""
    from collections import Counter
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if noise and h % noise == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += len(word) >= min_chars
    n = {w: c for w, c in counts.items() if c >= min_count}
    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    form, near = {}, {}
    for w in n:
        near[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size[size] if one_edit(w, v)]
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def plain_words(text):
    out = []
    for piece in text.lower().split():
        piece = re.sub(r"^[\W_]+|[\W_]+$", "", piece)
        if piece:
            out.append(piece)
    return out


def contaminations(text, items, share=0.8, size=5):
    """Items of which ``share`` of the shingles, or of those of each half, stand in one window of the text that the
    longest item fits in."""
    words = plain_words(text or "")
    stride = max([32, *(len(plain_words(t or "")) for _, t in items)])
    windows = []
    for start in range(0, max(1, len(words)), stride):
        part = words[start:start + 2 * stride]
        windows.append({n: {tuple(part[j:j + n]) for j in range(len(part) - n + 1)} for n in range(1, size + 1)})
    found = set()
    for item, t in items:
        ws = plain_words(t or "")
        if not ws:
            continue
        half = max(1, len(ws) // 2)
        parts = (ws, ws[:half], ws[half:]) if len(ws) >= 2 * size else (ws, ws, ws)

        def overlap(part, window):
            n = min(size, len(part))
            own = {tuple(part[j:j + n]) for j in range(len(part) - n + 1)}
            return len(own & window[n]) / len(own)
        for window in windows:
            whole, *halves = (overlap(p, window) for p in parts)
            if whole >= share or min(halves) >= share:
                found.add(item)
                break
    return found


def order_minhash(data, window=8, bins=64, per_bin=2):
    """One integer of 16 bits per bin: the least hashes of the bin's occurrence-numbered windows, in text order."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)
    starts = range(len(data) - window + 1) if len(data) > window else range(1 if data else 0)
    seen, chosen = defaultdict(int), defaultdict(list)
    for at in starts:
        kmer = int.from_bytes(data[at:at + window].ljust(window, b"\0"), "little")
        numbered = mix(kmer ^ (seen[kmer] * 0x9E3779B97F4A7C15 & mask))
        seen[kmer] += 1
        z = mix(numbered)
        chosen[z >> 58].append((z, at, numbered))
    out = []
    for b in range(bins):
        least = sorted(sorted(chosen[b])[:per_bin], key=lambda x: x[1])
        full = 0
        for _, _, numbered in least:
            full = mix(full * 31 + numbered + 1 & mask)
        out.append(full % 0xFFFF + 1 if least else 0)
    return out
