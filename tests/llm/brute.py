"""Plain Python versions of the corpus operators, by definition rather than by method."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return (text or "").translate(UPPER)


def contamination(docs, items, span=10):
    """doc rows (id, text), item rows (id, text) to a list of (id, n_words, n_hit, n_items, sha, flag)."""
    wanted = defaultdict(set)
    for item, text in items:
        words = PLAIN.findall(lower(text))
        n = min(span, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            wanted[tuple(words[i : i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in wanted}
    out = []
    for doc, text in docs:
        words, hit, found = PLAIN.findall(lower(text)), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if names := wanted.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_groups(docs, k=5, percent=80):
    """Rows (id, n_shingles, component, kept); every pair is compared."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(docs):
        component = min(least[find(i)], default=None)
        out.append((doc, len(sets[i]), component, doc == component))
    return out


def exact_groups(docs, best=max):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[text or ""].append(doc)
    out = []
    for doc, text in docs:
        ids = [d for d in groups[text or ""] if d is not None]
        keep = best(ids) if ids else None
        out.append((doc, keep, len(groups[text or ""]), doc == keep, sha(text or "")))
    return out


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def base_spans(text):
    out = []
    for rank, pattern, least, group in (
        (1, ASSIGN, 6, 2), (2, re.compile(r"AKIA[A-Z0-9]+"), 20, 0), (3, re.compile(r"[0-9a-f]+"), 24, 0)
    ):
        out += [(m.start(), rank, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def entropy(window: str) -> float:
    n = len(window)
    return -sum(c / n * math.log2(c / n) for c in Counter(window).values())


def entropy_spans(text, config):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % config.window, text or ""):
        word = m.group()
        if any(re.search(p, word) for p in config.allowed):
            continue
        bound = next((bits for c, bits in config.classes if re.fullmatch(f"{c}+", word)), config.mixed_bits)
        runs = []
        for i in range(len(word) - config.window + 1):
            if entropy(word[i : i + config.window]) >= bound:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + config.window
                else:
                    runs.append([i, i + config.window])
        out += [(m.start() + a, 4, m.start() + b) for a, b in runs]
    base = base_spans(text)
    return [s for s in out if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]


def targets(sizes: dict, weights=(3, 1, 2), budget=Fraction(3, 2), epochs=2):
    """Shares by weight, capped and reshared until none is above its most."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()) * budget, {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: Fraction(weight[s] * left, sum(weight[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] >= epochs * sizes[s]}
        if not over:
            out.update(share)
            break
        out.update({s: Fraction(epochs * sizes[s]) for s in over})
        open_ -= over
    return out


def mix(docs, seed="mix", epochs=2):
    """Rows (id, source, text) to (id, size, source_size, target, taken) by one queue on one machine."""
    rows = [(d, s, len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))) for d, s, t in docs]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = targets(dict(sizes)) if rows else {}
    key = lambda d, n: hashlib.md5((seed + (f"null:{n}" if d is None else str(d))).encode()).hexdigest()[:16]
    queue, done = [], Counter()
    order = sorted(range(len(rows)), key=lambda i: (key(rows[i][0], rows[i][2]), rows[i][0] if rows[i][0] is not None else -(10**18), rows[i][2]))
    for i in order:
        _, s, n = rows[i]
        done[s] += n
        if n:
            queue += [((done[s] + e * sizes[s]) / float(target[s]), i) for e in range(epochs)]
    taken, left = Counter(), int(sum(sizes.values()) * 3 // 2)
    for _, group in itertools.groupby(sorted(queue), key=lambda q: q[0]):
        group = list(group)
        words = sum(rows[i][2] for _, i in group)
        if words > left:
            break
        left -= words
        for _, i in group:
            taken[i] += rows[i][2]
    return [(d, n, sizes[s], float(target[s]), taken[i]) for i, (d, s, n) in enumerate(rows)]


def maximal_chats(turns):
    """Rows (conv, turn, role, text) to the ids of conversations that begin no longer one."""
    convs = defaultdict(list)
    for conv, turn, role, text in turns:
        convs[conv].append((turn is not None, turn or 0, role, text))
    said = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    return {c for c, v in said.items() if not any(len(w) > len(v) and w[: len(v)] == v for w in said.values())}


def units(text, least=5):
    """(words, start, stop): sentences or lines of ``least`` words, with the shorter ones before them."""
    out, start = [], 0
    for piece in re.finditer(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", text):
        if len(piece.group().encode().split()) >= least:
            out.append((tuple(text[start : piece.end()].encode().lower().split()), start, piece.end()))
            start = piece.end()
    if text[start:].encode().split():
        out.append((tuple(text[start:].encode().lower().split()), start, len(text)))
    return out


def repeats(docs, keys, most=25):
    """Rows (id, text) with a tie-breaking key each to (id, text without repeats, removed (start, stop))."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, keys[i]))
    cut = [units(text or "") for _, text in docs]
    first = {}
    for i in order:
        for k, (words, _, _) in enumerate(cut[i]):
            first.setdefault(words, (docs[i][0], keys[i], k))
    out = []
    for i, (doc, text) in enumerate(docs):
        spans, run = [], []
        for k, (words, start, stop) in enumerate([*cut[i], ((), 0, 0)]):
            there = first.get(words)
            again = there is not None and there != (doc, keys[i], k)
            if run and again and there[1] == run[-1][0]:
                run.append((there[1], len(words), start, stop))
                continue
            if sum(r[1] for r in run) > most:
                if spans and spans[-1][1] == run[0][2]:
                    spans[-1] = (spans[-1][0], run[-1][3])
                else:
                    spans.append((run[0][2], run[-1][3]))
            run = [(there[1], len(words), start, stop)] if again else []
        left, at = "", 0
        for start, stop in spans:
            left, at = left + text[at:start], stop
        out.append((doc, text if text is None else left + text[at:], spans))
    return out
