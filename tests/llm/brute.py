"""Plain versions of the operators, for small tables."""

import itertools
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(sets, percent=80):
    """sets: id -> set; id -> smallest id reachable over links."""
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}


def contamination(text, items, size=13):
    """items: id -> text. (n_words, hit places, item ids)."""
    w, hit, ids = words(text), set(), set()
    for i, t in items.items():
        own = words(t)
        n = min(size, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    ids.add(i)
    return len(w), hit, ids


def places(text, phrase):
    w, p = words(text), phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def line_templates(rows, depth=4, min_docs=2, percent=70, constant_percent=10, short_tokens=5, short_min_docs=5):
    """rows: (doc_id, text); the texts after recurring templates are dropped."""
    split = lambda line: tuple(x for x in re.split(r"[\x09-\x0D\x20]+", line) if x)
    docs = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(split(line)) >= short_tokens or not all(re.search("[0-9]", x) for x in split(line)):
                docs.setdefault(split(line), set()).add(doc_id)
    leaves = {}
    for t in docs:
        shown = tuple("<*>" if re.search("[0-9]", x) else x for x in t)
        leaves.setdefault((len(t), shown[: min(depth, (len(t) + 1) // 2)]), []).append((t, shown))
    group = {}
    for (n, lead), own in leaves.items():
        lead = len(lead)
        fits = lambda name: 100 * name.count("<*>") <= (100 - percent) * n or (name.count("<*>") == 1 and n >= 3)  # noqa: E731, B023

        def constant(lines, shown, i, near):
            around = lambda s: [s[i + k] if 0 <= i + k < n else "" for k in near]  # noqa: E731, B023
            alike = [(len(docs[o]), s[i] == shown[i]) for o, s in lines if around(s) == around(shown)]
            count = sum(c for c, same in alike if same)
            return count >= min_docs and 100 * count >= constant_percent * sum(c for c, _ in alike)

        names = {t: [x if i < lead or constant(own, s, i, ()) else "<*>" for i, x in enumerate(s)] for t, s in own}  # noqa: B023
        others = [(t, s) for t, s in own if not fits(names[t])]
        for t, s in others:
            names[t] = [y if y != "<*>" or not any(constant(others, s, i, near) for near in ((-2, -1), (1, 2), (-1, 1), (-2, 2))) else s[i] for i, y in enumerate(names[t])]
        for t, name in names.items():
            group.setdefault((True, tuple(name)) if "<*>" in name and fits(name) else (False, t), []).append(t)
    lost = {}
    for own in group.values():
        having = set().union(*(docs[t] for t in own))
        if len(having) >= (short_min_docs if len(own[0]) < short_tokens else min_docs):
            lost.update({t: min(having) for t in own})
    return [(d, t if t is None else "\n".join(x for x in t.split("\n") if lost.get(split(x), d) == d)) for d, t in rows]
