"""Plain versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter

import numpy as np

LOW = {i: i + 32 for i in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


def shingles(text, width):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(texts, width, percent=80):
    """texts: {id: text} -> {id: smallest id reachable}."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def contained(docs, items, width=5, percent=80):
    out = set()
    for d, text in docs:
        own = shingles(text, width)
        for i, item in items:
            s = shingles(item, width)
            if s and 100 * len(s & own) >= percent * len(s):
                out.add((d, i, len(s), len(s & own)))
    return out


def base_lm(docs):
    """[(id, text)] -> per row (held_out, n_tokens, n_known, train_tokens, base_score)."""
    toks = [words(t) + ["\n"] for _, t in docs]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(h, len(t), sum(c[w] > 0 for w in t), n, float(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))) for t, h in zip(toks, held)]


def letter_costs(strings, code, table, sure, weights):
    """Code length of each byte of each string under each weight set, one decision after another."""
    from tarnlake.llm import lm_mixing as lm
    from tarnlake.llm import text as T

    seeds, mask = [int(x) for x in lm._SEEDS], 2**64 - 1
    rough = [0, 0, 1, 1, 2]
    out = []
    for b in strings:
        rows = []
        for j, c in enumerate(b):
            hashes, h, done = [], 0, 0
            for order, _ in lm.ORDERS:
                for k in range(done + 1, order + 1):
                    h = (h + (b[j - k] + 1 if j >= k else 0) * seeds[k]) & mask
                done = order
                hashes.append(int(T.mix(np.array([(h * seeds[0] + order) & mask], np.uint64))[0]))
            cost = np.zeros(len(weights))
            for d in range(code.start[c], code.start[c + 1]):
                slot = [((((x + int(code.node[d]) * int(T._MULT)) & mask) * seeds[62]) & mask) >> (64 - bits) for x, (_, bits) in zip(hashes, lm.ORDERS)]
                slot = [x + int(o) for x, o in zip(slot, lm._OFFSET)]
                s, u = table[slot].astype(float) * (1 if code.branch[d] else -1), sure[slot]
                gate = (u[4] * 3 + rough[u[3]], min(j, lm.CHOICES - 1), u[2] * 3 + rough[u[1]])
                for k, (which, _) in enumerate(lm.SETS):
                    cost[k] += np.log1p(np.exp(np.clip(-(s @ weights[k][gate[which]]), -12, 12)))
            rows.append(cost)
        out.append(np.array(rows))
    return out


def mixed_scores(docs, cost, lm):
    """log10 probability of each text of [(id, text)]; ``cost`` has each word's code length by weight set."""
    toks = [words(t) + ["\n"] for _, t in docs]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in docs]
    grams = lambda t, k: [tuple(t[max(0, i - k) : i + 1]) if i >= k else ("start", k - i, *t[: i + 1]) for i in range(len(t))]
    count = [Counter(g for t, y in zip(toks, train) if y for g in grams(t, k)) for k in range(3)]
    out = []
    for t, y in zip(toks, train):
        own = [Counter(grams(t, k)) if y else Counter() for k in range(3)]
        past = [Counter() for _ in range(3)]
        n_all = sum(count[0].values()) - (len(t) if y else 0)
        n = []
        for i in range(len(t)):
            g = [grams(t, k)[i] for k in range(3)] if i < 3 else [tuple(t[i - k : i + 1]) for k in range(3)]
            n.append([count[k][g[k]] - own[k][g[k]] + past[k][g[k]] for k in range(3)])
            for k in range(3):
                past[k][g[k]] += 1
        sets = np.full(len(lm.SETS), 1 / len(lm.SETS))
        state = {k: {} for k in (1, 2, 3)}
        total = 0.0
        for lo in range(0, len(t), lm.STEP):
            spent, learned = np.zeros(len(sets)), []
            for i in range(lo, min(len(t), lo + lm.STEP)):
                c = np.array(cost[t[i]])
                p = float(np.log(np.exp(np.log(sets) - c + c.min()).sum()) - c.min())
                shares = []
                for k in (1, 2, 3):
                    if k == 1:
                        context, gate = n_all + i, int(i > 0 and n[i - 1][0] > 0)
                    else:
                        context = n[i - 1][k - 2] if i else 0
                        gate = min(int(np.log2(max(context, 1))), lm.GATES[k] // 2 - 1) * 2 + int(i > 0 and n[i - 1][k - 1] > 0)
                    if not context:
                        continue
                    found, seen = state[k].get(gate, lm.PRIOR)
                    part = found / seen
                    a = np.log(part * n[i][k - 1] / context) if n[i][k - 1] else -np.inf
                    new = np.logaddexp(a, np.log1p(-part) + p)
                    shares.append((k, gate, float(np.exp(a - new))))
                    p = float(new)
                rest = 1.0
                for k, gate, share in reversed(shares):
                    learned.append((k, gate, rest * share, rest))
                    rest *= 1 - share
                spent += rest * c
                total += p
            for k, gate, x, z in learned:
                found, seen = state[k].get(gate, lm.PRIOR)
                state[k][gate] = (found + x, seen + z)
            s = np.log(sets) - spent
            s = np.exp(s - s.max())
            sets = (1 - lm.SHARE) * s / s.sum() + lm.SHARE / len(sets)
        out.append(total / np.log(10))
    return out
