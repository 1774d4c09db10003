"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import collections
import fractions
import hashlib
import math
import re
import zlib

SPACES = "[ \t\n\x0b\f\r]+"
WORD = re.compile("[^ \t\n\x0b\f\r]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SECRETS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
     lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secret_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def quality_counts(text):
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def shingles(text, n=5):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows):
    """``rows``: (id, text); component of each position."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def removed(rows, size=35):
    all_words = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + size]) for w in all_words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, all_words, strict=True):
        hit = {j for i in range(len(w) - size + 1) if seen[tuple(w[i:i + size])] > 1 for j in range(i, i + size)}
        out.append((d, len(w), len(hit), sha(" ".join(x for j, x in enumerate(w) if j not in hit))))
    return out


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return ALNUM.findall((text or "").translate(FOLD))


def periodic(words, least=24, times=3):
    """All runs by comparing every word with that one period on."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, times * q) and not any(
                    all(words[k] == words[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_row(doc_id, text, plant):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = periodic(w)
    best = min(found, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def license_row(doc_id, text, phrases, texts, share, drift, gap, stretch):
    w = plain_words(text)
    base, labels, best = [], set(), 0.0
    for t in phrases:
        p = plain_words(t.text)
        here = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        base += [(i, t.label) for i in here]
    for t in texts:
        p = plain_words(t.text)
        diagonals = {}
        for i in range(len(w) - 2):
            for j in range(len(p) - 2):
                if w[i:i + 3] == p[j:j + 3]:
                    diagonals.setdefault(i - j, []).append((i, j))
        spans = []
        for i0, j0, d, votes in sorted((v[0][0], v[0][1], d, v) for d, v in diagonals.items()):
            if spans and abs(d - spans[-1][1]) <= drift and i0 - spans[-1][2] <= gap and j0 > spans[-1][3]:
                spans[-1] = (spans[-1][0], d, votes[-1][0], j0, spans[-1][4] + votes)
            else:
                spans.append((i0, d, votes[-1][0], j0, votes))
        for *_, votes in spans:
            length = max(i for i, _ in votes) + 3 - min(i for i, _ in votes)
            if len(votes) >= share * (len(p) - 2) and length <= stretch * len(p):
                labels.add(t.label)
                best = max(best, min(1.0, round(len(votes) / (len(p) - 2), 6)))
    kinds = {x for _, x in base}
    return (doc_id, len(w), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
            ",".join(sorted(kinds)), ",".join(sorted(kinds | labels)), 1.0 if base else best)


def resampled(rows, target, grams=1, buckets=10_000, least=20, percent=10, seed=2024):
    def feats(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(feats(x))
    for x in target:
        t.update(feats(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        f = feats(x)
        weight = sum(gain[b] for b in f)
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


def site_log_odds(rows):
    """``rows``: (host, path, evidence); shrunk log odds of each (host, path) over the global ones."""
    sites, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for h, p, x in rows:
        sites[h, p].append(x)
        hosts[h].append(x)
    n = len(rows)
    mu = sum(x for *_, x in rows) / n
    within = mu * (1 - mu)

    def strength(spread, groups):
        between = max((spread - (groups - 1) * within) / n, within * 1e-4)
        return min(max(within / between - 1, 2.0), 10_000.0)
    mean = {k: sum(v) / len(v) for k, v in (*sites.items(), *hosts.items())}
    of_host = strength(sum(len(v) * mean[k] ** 2 for k, v in hosts.items()) - n * mu * mu, len(hosts))
    of_path = strength(sum(len(v) * (mean[k] - mean[k[0]]) ** 2 for k, v in sites.items()), len(sites) - len(hosts) + 1)
    shrunk = {h: (sum(v) + of_host * mu) / (len(v) + of_host) for h, v in hosts.items()}
    logit = lambda p: math.log(p / (1 - p))
    return {k: logit((sum(v) + of_path * shrunk[k[0]]) / (len(v) + of_path)) - logit(mu) for k, v in sites.items()}


def languages(rows, longest=5, smooth=0.2):
    """``rows``: (id, text, lang); language, score and held-out flag by id."""
    runs = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    cut = lambda w, n: [x[i:i + n] for x in [f"\x02{w}\x03" if n > 1 else w] for i in range(len(x) - n + 1)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    count = collections.defaultdict(collections.Counter)
    for i, t, lang in rows:
        if t is not None and lang is not None and not held(i):
            for w in runs(t):
                count[lang, 0][w] += 1
                for n in range(1, longest + 1):
                    count[lang, n].update(cut(w, n))
    langs = sorted({x for x, _ in count})
    known = [set().union(*(count[x, n] for x in langs)) for n in range(longest + 1)]
    kinds = [max(len(count[x, n]) for x in langs) for n in range(longest + 1)]
    total = {k: sum(v.values()) for k, v in count.items()}
    log = lambda x, n, u: math.log((count[x, n][u] + smooth) / (total[x, n] + smooth * kinds[n]))
    all_words = sum(total[x, 0] for x in langs)
    prior = {x: math.log((total[x, 0] + 1) / (all_words + len(langs))) for x in langs}
    memo, out = {}, {}

    def evidence(w):
        if w not in memo:
            units = [(0, w)] if w in known[0] else next(
                (u for n in range(longest, 0, -1) if (u := [(n, g) for g in cut(w, n) if g in known[n]])), [])
            memo[w] = {x: sum(log(x, n, u) for n, u in units) / len(units) if units else 0.0 for x in langs}
        return memo[w]
    for i, t, _ in rows:
        found = [evidence(w) for token in (t or "").split() for w in runs(token)]
        if not found:
            out[i] = ("und", 0.0, held(i))
            continue
        v = {x: prior[x] + sum(f[x] for f in found) for x in langs}
        best = max(langs, key=lambda x: v[x])
        out[i] = (best, 1 / sum(math.exp(v[x] - v[best]) for x in langs), held(i))
    return out
