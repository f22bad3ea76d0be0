"""Plain Python forms of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    return (text or "").encode().translate(bytes.maketrans(UPPER, LOWER))


def words(text):
    return WORD.findall(lowered(text))


def crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


class Sets:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def base_scores(docs):
    counts = collections.Counter()
    for key, text in docs:
        if crc(key) % 7 != 2:
            counts.update(words(text))
            counts[b""] += 1
    total, kinds, out = sum(counts.values()), len(counts), []
    for key, text in docs:
        tokens = words(text) + [b""]
        score = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        out.append((key, crc(key) % 7 == 2, len(tokens), sum(t in counts for t in tokens), total, score))
    return out


def fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def simhash(docs):
    """{key: (fingerprint, component)}"""
    prints, sets = {}, Sets()
    for key, text in docs:
        prints[key] = fingerprint(text)
        sets.find(key)
    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                sets.join(a, b)
    return {k: (f"{prints[k]:016x}", sets.find(k)) for k in keys}


def removed(docs, length):
    """{key: (bytes, removed, spans, digest)}"""
    seen, out = set(), {}
    for key, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s:s + length]
            if window in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def paragraphs(docs, min_words, similarity):
    """{(key, line): (kept key, kept line)} of repeated paragraphs."""
    rows = []
    for key, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            w = words(line)
            if len(w) >= min_words:
                rows.append((key, i, {tuple(w[k:k + 5]) for k in range(len(w) - 4)}))
    rows.sort(key=lambda r: r[:2])
    sets = Sets()
    for i, a in enumerate(rows):
        for j in range(i):
            both = len(a[2] & rows[j][2])
            if both >= similarity * (len(a[2]) + len(rows[j][2]) - both) - 1e-9:
                sets.join(i, j)
    return {rows[i][:2]: rows[sets.find(i)][:2] for i in range(len(rows)) if sets.find(i) != i}


def mixture(docs):
    """{source: (size, target)} of (key, text, source) rows."""
    sizes = collections.Counter()
    for _, text, source in docs:
        sizes[source] += len(words(text))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, live, goal = 1.5 * sum(sizes.values()), set(names), {}
    while live:
        level = left / sum(weight[s] for s in live)
        full = [s for s in live if level * weight[s] > 2 * sizes[s]]
        if not full:
            goal |= {s: level * weight[s] for s in live}
            break
        for s in full:
            goal[s] = 2 * sizes[s]
            left -= goal[s]
            live.discard(s)
    return {s: (sizes[s], goal[s]) for s in names}


def hard_negatives(rows):
    """Rows (anchor, positive, rank, negative, scores) from (id, vector, label), anchors every 50th."""
    use = [(k, [math.floor(256 * x) for x in v], (label + 1) % 10 if k % 7 == 0 else label) for k, v, label in rows
           if None not in (k, v, label) and None not in v and all(map(math.isfinite, v))]
    out = []
    for k, v, label in use:
        if k % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in use if j != k)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(k, positive, i + 1, j, -p, -s) for i, (s, j, _) in enumerate(fits)]
    return out


def weighted_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    votes, total = [0] * 64, 0
    for a, b in zip(found, [*found[1:], None]):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        weight = len(a) + len(b or "")
        total += weight
        votes = [v + weight * (h >> i & 1) for i, v in enumerate(votes)]
    return sum(1 << i for i, v in enumerate(votes) if 2 * v > total)


def fingerprints(docs, radius=3, every=100):
    """Rows of (key, text): key, n_chars, digest, both fingerprints, both likenesses, rows within the radius."""
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    prints = [weighted_fingerprint(t) for _, t in docs]
    out = []
    for i, (key, text) in enumerate(docs):
        text, after = text or "", (i + 1) % len(docs)
        half = len(text) // 2
        edited = text[:len(text) - half] + (docs[after][1] or "")[:half]
        other = weighted_fingerprint(edited)
        near = [1 - (prints[i] ^ x).bit_count() / 64 for x in (other, prints[after])]
        count = sum((x ^ prints[i]).bit_count() <= radius for x in prints) if key is not None and key % every == 0 else None
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[i]:016x}", f"{other:016x}", *near, count))
    return out


def manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text): key, leaf, subroot, root, proof, folded root, verified."""
    def h(*inputs):
        return hashlib.sha256("".join(inputs).encode()).hexdigest()

    def leaf(*values):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def build(level):
        paths, places = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for path, at in zip(paths, places):
                path.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else ""))
            level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
            places = [at // 2 for at in places]
        return level[0], paths

    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: build([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    root, above = build([built[t][0] for t in names])
    out = []
    for name, end in zip(names, above):
        subroot, paths = built[name]
        for (_, _, own, r), path in zip(sorted(trees[name], key=lambda x: x[:3]), paths):
            bent = r[0] is not None and crc(r[0]) % 7 == 0 and r[3] is not None
            at = leaf(*r[:3], r[3] + 1, r[4]) if bent else own
            for odd, other in path + end:
                at = h(other, at) if odd else h(at, other)
            out.append((r[0], own, subroot, root, h(*[x for _, x in path + end]), at, at == root))
    return out


def model_scores(docs, mu):
    """Interpolated log10 P of each text, counts as their quantised levels have it, without false finds."""
    def held(n, base=1.5):
        j = 0
        while math.ceil(base ** (j + 1) - 1e-9) <= n:
            j += 1
        low, high = math.ceil(base ** j - 1e-9), math.ceil(base ** (j + 1) - 1e-9) - 1
        return (low + max(low, high)) / 2 if n else 0.0

    one, two, starts = collections.Counter(), collections.Counter(), 0
    for key, text in docs:
        if crc(key) % 7 != 2:
            tokens = [None, *words(text), b""]
            one.update(tokens[1:])
            two.update(zip(tokens, tokens[1:]))
            starts += 1
    total, mass = sum(one.values()), sum(held(n) for n in one.values())
    unseen = min(0.5, max(sum(n == 1 for n in one.values()), 1) / max(total, 1))

    def p(w):
        return (1 - unseen) * held(one[w]) / max(mass, 1) if w in one else unseen / (len(one) + 1)

    out = []
    for _, text in docs:
        tokens, score = [None, *words(text), b""], 0.0
        for v, w in zip(tokens, tokens[1:]):
            before = starts if v is None else held(one[v])
            score += math.log10((min(held(two[v, w]), held(one[w]), before) + mu * p(w)) / (before + mu))
        out.append(score)
    return out, sum(p(w) for w in one) + (len(one) + 1) * p(object())
