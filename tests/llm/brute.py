"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bare(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(rows, n=13):
    """rows: (doc_id, text) -> list of (doc_id, n_words, n_removed, sha of the words left)."""
    low = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            if d is not None:
                g = tuple(w[i:i + n])
                low[g] = min(low.get(g, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and low[tuple(w[i:i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text, n=5):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near(rows):
    """rows: (doc_id, text), ids set -> list of (doc_id, n_shingles, component_id, kept)."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), find(d), d == find(d)) for d, s in sets]


def text_stats(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))


def quality(rows, min_docs, min_left):
    """rows: (doc_id, source, text) -> list of (doc_id, *stats, base_failed, kept, text left)."""
    holders = defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[1-9]", "0", x.translate(UPPER))).strip(" ")
    for d, s, t in rows:
        for line in (t or "").split("\n"):
            if words(line):
                holders[s, norm(line)].add(d)
    out = []
    for d, s, t in rows:
        stats = text_stats(t)
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        left = []
        for line in (t or "").split("\n"):
            h = holders.get((s, norm(line)), ()) if words(line) else ()
            if len(h) <= min_docs or min(h) == d:
                left.append(line)
        text = None if t is None else "\n".join(left)
        out.append((d, *stats, failed, not failed and len(words(text)) >= stats[0] * min_left, text))
    return out


def decontaminate(rows, items, n=13):
    grams = {}
    for i, t in items:
        w = bare(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in rows:
        w, hit, found = bare(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                g = tuple(w[i:i + size])
                if g in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def line_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 2147483647 for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or i and (h[i - 1] * 1_000_003 + h[i]) % 2147483647 % 3 == 0:
            out.append((start, i + 1))
            start = i + 1
    return lines, out


def dedup_lines(rows):
    """rows: (doc_id, text), ids set -> list of (doc_id, n_lines, n_chunks, n_removed_lines, text)."""
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((d, 0, 0, 0, None))
            continue
        lines, cuts = line_chunks(t)
        kept, gone = [], 0
        for a, b in cuts:
            chunk = "\n".join(lines[a:b])
            if b - a >= 2 and words(chunk) and seen.setdefault(chunk, (d, t, a)) not in ((d, t, a),):
                gone += b - a
            else:
                kept.append(chunk)
        out.append((d, len(lines), len(cuts), gone, "\n".join(kept)))
    return out


def dedup_runs(rows):
    """rows: (doc_id, text), ids set -> {doc_id: (n_removed_lines, text)}; pairs of lines in order of place."""
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines, gone = [] if t is None else t.split("\n"), set()
        for i in range(len(lines) - 1):
            if words(lines[i]) or words(lines[i + 1]):
                at = seen.setdefault((lines[i], lines[i + 1]), (d, i))
                if at != (d, i) and at != (d, i - 1):
                    gone.update((i, i + 1))
        out[d] = (len(gone), t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def targets(sizes):
    """sizes: source -> words; targets by resharing until none is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update((s, 3 * sizes[s]) for s in over)


KINDS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def secrets(text):
    rows = []
    for i, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(1)) >= LEAST[kind]:
                rows.append((m.start(), i, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(rows))


def model_spans(text, alphabet, model, threshold):
    """Runs of 20 symbols or more that no base span overlaps and whose steps add up to the threshold."""
    k, out = len(alphabet), []
    base = [tuple(map(int, x.split(":")[1:])) for x in secrets(text).split(",") if x]
    for m in re.finditer("[" + re.escape(alphabet) + "]{20,}", text or ""):
        steps = sum(round(1000 * model[alphabet.index(a) * k + alphabet.index(b)]) for a, b in zip(m.group(), m.group()[1:]))
        if steps >= 1000 * threshold and not any(a < m.end() and m.start() < b for a, b in base):
            out.append((m.start(), m.end()))
    return out


def best_tokens(token, scores, floor):
    """Highest score and its token counts by trying all splits from the left."""
    best = [(0.0, 0)]
    for i in range(1, len(token) + 1):
        options = []
        for j in range(i):
            piece = token[j:i]
            if piece in scores:
                options.append((best[j][0] + scores[piece], best[j][1] + 1, j))
        if token[i - 1] not in scores:
            size = len(token[i - 1].encode())
            options.append((best[i - 1][0] + size * floor, best[i - 1][1] + size, i - 1))
        top = max(o[0] for o in options)
        best.append(min((o for o in options if o[0] == top), key=lambda o: o[2])[:2])
    return best[-1]
