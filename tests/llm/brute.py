"""Plain Python versions of the operators, over lists of rows."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def components(nodes, linked):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        low[y] = x
    return {n: find(n) for n in nodes}


def jaccard_links(sets, percent=80):
    """All pairs; sets: key to set."""
    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    yield a, b


def near(docs, k):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()
    low = components(sets, jaccard_links(sets))
    return {i: (len(sets[i]), low[i], low[i] == i) for i in sets}


def lines(docs):
    """docs: (doc_id, text), ids distinct; doc_id to removed line numbers."""
    at, sets = defaultdict(list), {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if t is not None and WORD.search(line):
                line = line.lower()
                at[line].append((i, n))
                padded = line + "\0" * 7
                sets[line] = {padded[j:j + 8] for j in range(len(line))}
    groups = defaultdict(list)
    for line, root in components(sets, jaccard_links(sets)).items():
        groups[root] += at[line]
    out = defaultdict(list)
    for places in groups.values():
        for i, n in sorted(places)[1:]:
            out[i].append(n)
    return {i: sorted(out[i]) for i, _ in docs}


def secrets(text):
    rules = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
             ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    rows = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p, g, least) in enumerate(rules) for m in re.finditer(p, text or "") if len(m[g]) >= least]
    count = Counter(n for _, n, _ in rows)
    return count[0], count[1], count[2], sha(",".join(x for *_, x in sorted(rows)))


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def pages(rows):
    """rows: (page_id, html), ids distinct."""
    data = {i: (h or "").encode() for i, h in rows}
    last = {}
    for i, x in data.items():
        last[x] = max(i, last.get(x, i))
    return {i: (len(x), hashlib.sha1(x).hexdigest(), *(("revisit", last[x]) if len(x) >= 1000 and last[x] != i else ("response", None))) for i, x in data.items()}


def edited(docs):
    """docs: (doc_id, text), ids distinct; doc_id to (n_chars, SHA-256 of the edited text)."""
    rows = sorted((i, t or "") for i, t in docs)
    out = {}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        out[i] = len(t), sha(t[:len(t) - half] + after[:half])
    return out
