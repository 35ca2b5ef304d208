"""The operators in plain Python, one text, word or pair at a time: what the vectorised code is held against."""

import hashlib
import math

import xxhash

from riskweave.llm import language_id as li
from riskweave.llm import mixing, parsing, words

FULL = 2**64 - 1


def text_hash(text):
    """Spark's xxhash64 of a text; 42, its seed, for a null."""
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def shingles(text):
    w = words.folded_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# -- locally consistent parsing --


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def toss(a, b):
    """Twice the place of the lowest bit in which b differs from a, plus that bit of b."""
    place = ((a ^ b) & -(a ^ b)).bit_length() - 1
    return 2 * place + (b >> place & 1)


def phrase_names(values, bytes_):
    """Names of the phrases that ``values`` are parsed into."""
    runs = []
    for v in values:
        if runs and runs[-1][0] == v:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    labels = [v for v, _ in runs]
    for _ in range(3 if bytes_ else 4):  # names have 64 bits, bytes 8: one toss more until six labels are left
        labels = [toss(labels[i - 1] if i else b ^ 1, b) for i, b in enumerate(labels)]
    assert max(labels, default=0) < 6
    phrases = []
    for i, (v, n) in enumerate(runs):
        left, right = labels[i - 1] if i else 0, labels[i + 1] if i + 1 < len(labels) else 0
        value = int(words._BYTE[v]) if bytes_ else v
        if n > 1:
            value = mix(value + n & FULL)
        if i == 0 or labels[i] > left and labels[i] >= right:
            phrases.append([])
        phrases[-1].append(value)
    return [mix((sum(x * pow(0xD1342543DE82EF95, k, 2**64) for k, x in enumerate(p)) + len(p) * 0x9E3779B97F4A7C15) & FULL) for p in phrases]


def sketch(text):
    names, own = list((text or "").encode()), set()
    for level in (1, 2, 3):
        names = phrase_names(names, level == 1)
        own |= {mix(x ^ 0xA5A5 * level) for x in names}
    return sorted(own)[: parsing.SKETCH]


def likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    both = sorted({*a, *b})
    if max(len(a), len(b)) == parsing.SKETCH:
        both = both[: parsing.SKETCH]
    return len({*a} & {*b} & {*both}) / len(both)


# -- the recurrent network --


def gate(x):
    return x / (1 + abs(x))


def states(net, window, d):
    """The hidden states of one direction, one byte after the other."""
    p, h, out = net.p, [0.0] * li.HIDDEN, {}
    n = li.HIDDEN
    for t in range(len(window)) if d == "f" else reversed(range(len(window))):
        a = [float(p[f"in_{d}"][i][window[t]]) for i in range(3 * n)]
        u = [sum(float(p[f"rec_{d}"][i][j]) * h[j] for j in range(n)) for i in range(3 * n)]
        z = [0.5 + 0.5 * gate(a[i] + u[i]) for i in range(n)]
        r = [0.5 + 0.5 * gate(a[n + i] + u[n + i]) for i in range(n)]
        new = [gate(a[2 * n + i] + r[i] * u[2 * n + i]) for i in range(n)]
        h = [new[i] + z[i] * (h[i] - new[i]) for i in range(n)]
        out[t] = h
    return out


def language(net, text):
    """(language, score) of one text."""
    if not any(c.isalpha() for c in text or ""):
        return li.UND, 1.0
    raw, sums = text.encode(), [0.0] * len(net.languages)
    for at in range(0, len(raw), li.WINDOW):
        window = raw[at : at + li.WINDOW]
        f, b = states(net, window, "f"), states(net, window, "b")
        for t in range(len(window)):
            logits = [float(net.p["out"][k][0]) + sum(float(net.p["out_f"][k][j]) * f[t][j] + float(net.p["out_b"][k][j]) * b[t][j] for j in range(li.HIDDEN)) for k in range(len(net.languages))]
            top = max(logits)
            e = [math.exp(x - top) for x in logits]
            sums = [s + x / sum(e) for s, x in zip(sums, e, strict=True)]
    best = max(range(len(sums)), key=sums.__getitem__)
    return net.languages[best], sums[best] / len(raw)


# -- what the pipeline's stages keep: rows are dicts with doc_id, text and source --


def one_of_each(rows):
    sets, left = [shingles(r["text"]) for r in rows], set(range(len(rows)))
    near = lambda i, j: sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    kept = []
    while left:
        todo, group = [min(left)], []
        left.discard(todo[0])
        while todo:
            i = todo.pop()
            group.append(i)
            new = [j for j in left if near(i, j)]
            left -= {*new}
            todo += new
        kept.append(min(group, key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, text_hash(rows[i]["text"]))))
    return [rows[i] for i in sorted(kept)]


def without(rows, items):
    def holds(text, item):
        want, w = shingles(item), words.folded_words(text)
        if not want:
            return False
        n = len(next(iter(want)))
        return 5 * len(want & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) >= 4 * len(want)

    return [r for r in rows if not any(holds(r["text"], item) for item in items)]


def mixed(rows):
    out, sources = [], {r["source"] for r in rows}
    for r in rows:
        rate = len(rows) / len(sources) / sum(x["source"] == r["source"] for x in rows)
        assert rate <= mixing.SLICE
        u = int(hashlib.md5(f"{mixing.SEED}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [r] * k
    return out
