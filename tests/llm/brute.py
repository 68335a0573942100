"""Plain Python versions of the operators, for comparison on small inputs."""

import hashlib
import re

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    n = lambda kind: sum(s[3] == kind for s in spans)
    return n("assign"), n("access"), n("hex"), hashlib.sha256(joined.encode()).hexdigest()


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def closed(ids, links):
    """Smallest id reachable from each."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def jaccard(docs, percent=75):
    """docs: id to text. Gives id to (set size, component)."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holds = {}
    for i, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(i)
    both = {}
    for ids in holds.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {i: (len(sets[i]), c) for i, c in closed(list(docs), links).items()}


def near(vectors, threshold=0.93):
    """vectors: (id, vector, label) rows with different ids. Gives id to (links, component)."""
    import numpy as np

    good = [(i, np.array(v, dtype=float), lab) for i, v, lab in vectors if lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], {i: 0 for i, _, _ in vectors}
    for k, (i, v, lab) in enumerate(good):
        for j, w, other in good[k + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    return {i: (n[i], c) for i, c in closed([i for i, _, _ in vectors], links).items()}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def line_dedup(docs, min_chars=40, min_docs=5):
    """docs: id to text. Gives id to (lines, dropped, kept text)."""
    lines = {i: (t or "").split("\n") for i, t in docs.items()}
    holders = {}
    for i, ls in lines.items():
        for x in ls:
            if len(k := lower(x.strip(BLANKS))) >= min_chars:
                holders.setdefault(k, set()).add(i)
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= min_docs}
    out = {}
    for i, ls in lines.items():
        kept = [x for x in ls if gone.get(lower(x.strip(BLANKS)), i) == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def prefix_trie(rows, family=20, most=4):
    """rows: (conversation, turn, role, text). Gives the set of nodes' (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    import zlib

    key = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))
        kids = sum(len(n) == len(node) + 1 for n in below)
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), kids, sum(n not in inner for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out
