"""The operators by brute force, in plain Python."""

import re
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text, pattern=ALNUM):
    return pattern.findall(lower(text))


def decontaminated(documents, items, size=10):
    """(n_words, hit words, items) of each text."""
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        n = min(size, len(w))
        for a in range(len(w) - n + 1) if n and item_id is not None else ():
            windows[tuple(w[a : a + n])].add(item_id)
    out = []
    for text in documents:
        w, hit, of = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    of |= found
        out.append((len(w), hit, of))
    return out


def shingles(text, n=5):
    w = words(text, NOT_SPACE)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}


def components(rows, percent=75):
    """The smallest id reachable from each row of (id, text)."""
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                at[root(i)] = root(j)
    least = {}
    for i, (number, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), number), number)
    return [(number, len(s), least[root(i)]) for i, ((number, _), s) in enumerate(zip(rows, sets, strict=True))]


def passages(rows, min_words=20, min_line=10):
    """What line dedup keeps of each (id, text) in order of ids: lists of words."""
    cut, whole = [], []
    for _, text in rows:
        text = text or ""
        blocks = set()
        for kind in (r"\r\n|\r|\n", r"(?:\r\n|\r|\n)\s*?(?:\r\n|\r|\n)"):
            at = 0
            for piece in re.split(kind, text):
                size = len(ALNUM.findall(lower(piece)))
                if size >= min_line and (size < min_words or kind[0] == "("):
                    blocks.add((at, at + size))
                at += size
        whole.append(blocks)
        found = list(ALNUM.finditer(lower(text)))
        units, last = [], 0
        for i, m in enumerate(found):
            new = i == 0 or re.search("[.!?\n\r]", text[found[i - 1].end() : m.start()]) or text[m.start()].isupper()
            units += [i] if new else []
        cut.append((units + [len(found)], [lower(m.group()) for m in found]))
    seen, gone = {}, [set() for _ in rows]
    for k, (units, w) in enumerate(cut):
        windows = set(whole[k])
        for u in range(len(units) - 1):
            ends = [e for e in units[u + 1 :] if e - units[u] >= min_words]
            windows |= {(units[u], ends[0])} if ends else set()
            begins = [b for b in units[: u + 1] if units[u + 1] - b >= min_words]
            windows |= {(begins[-1], units[u + 1])} if begins else set()
        first = {}
        for a, b in sorted(windows):
            digest = tuple(w[a:b])
            if seen.get(digest, k) != k:
                gone[k].update(range(a, b))
            elif digest in first:
                gone[k].update(range(max(a, first[digest]), b))
            else:
                seen[digest], first[digest] = k, b
    return [[x for i, x in enumerate(w) if i not in gone[k]] for k, (_, w) in enumerate(cut)]
