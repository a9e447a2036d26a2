"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def roots(nodes, links):
    """Smallest node of each node's component."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(_LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def minhash_groups(docs, percent=85):
    """{doc_id: (n_shingles, component)} of (doc_id, text) with unique ids."""
    sets = {d: shingles(t) for d, t in docs}
    posted, links = {}, []
    for d, s in sets.items():
        common = Counter(o for x in s for o in posted.get(x, ()))
        links += [(o, d) for o, n in common.items() if 100 * n >= percent * (len(s) + len(sets[o]) - n)]
        for x in s:
            posted.setdefault(x, []).append(d)
    top = roots(sets, links)
    return {d: (len(s), top[d]) for d, s in sets.items()}


def vector_groups(rows, threshold=0.95):
    """{vec_id: (n_links, component)} of (vec_id, vector) with unique ids."""
    fine = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x) in enumerate(fine) for b, y in fine[k + 1 :] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]
    count, top = Counter(i for pair in links for i in pair), roots([i for i, _ in rows], links)
    return {i: (count[i], top[i]) for i, _ in rows}


def top_products(rows, k=5, divisor=50):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in fine:
        if q % divisor == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q)[:k]  # noqa: B905
            out |= {(q, place, i, -s) for place, (s, i) in enumerate(best, 1)}
    return out


def mix_targets(rows, weights=(1, 2, 3), most=3):
    """({source: size}, {source: target}) of (source, text)."""
    sizes = Counter()
    for source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full, total = {s: weights[i % len(weights)] for i, s in enumerate(order)}, set(), sum(sizes.values())
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else weight[s] * left / rest for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return sizes, target
        full |= over


def warc_rows(pages):
    """Multiset of (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    groups = {}
    for page_id, html in pages:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = Counter()
    for page_id, html in pages:
        data = (html or "").encode()
        ids = [i for i in groups[data] if i is not None]
        again = len(data) >= 1000 and len(groups[data]) > 1 and bool(ids) and page_id != max(ids)
        out[page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(ids) if again else None] += 1
    return out


def url_parts(url):
    _, mark, rest = (url or "").partition("://")
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL).groups() if mark else ("", "")
    return host.translate(_LOWER), path
