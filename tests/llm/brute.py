"""Plain versions of the operators, for small fixtures."""

import hashlib
import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, rid string, h1 string, text_ string"
SPACE = " \t\n\x0b\f\r"


def rows(texts, ids=None):
    return [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "x", None, "y", t) for i, t in enumerate(texts)]


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def odd_texts(seed=0, n=40):
    """Copies, near copies, shared passages and lines, nulls, empty and very long texts."""
    r = random.Random(seed)
    vocabulary = ["le", "été", "Of", "the", "and", "x1", "a,b", "##", "|", "ÉA", "naïve.", "z"] + [f"w{i}" for i in range(300)]
    text = lambda k: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(k))
    base = [text(r.randint(1, 160)) for _ in range(n)]
    passage, line = text(60).replace("\n", " "), "  A Shared line of boilerplate that is long enough \t"
    out = [None, "", "   ", "one", text(30_000)]
    for i, t in enumerate(base):
        out.append(t)
        if i % 4 == 0:
            out.append(t)
        if i % 5 == 0:
            w = t.split(" ")
            w[len(w) // 2] = "changed"
            out.append(" ".join(w))
        if i % 6 == 0:
            out.append(text(20) + passage + text(20))
        if i % 3 == 0:
            out.append(text(10) + "\n" + (line.upper() if i % 2 else line) + "\n" + text(5))
    return out


def passages(texts, k=35):
    where = defaultdict(list)
    split = [words(t) for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - k + 1):
            where[tuple(w[i : i + k])].append((d, i))
    gone = [set() for _ in texts]
    for at in where.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + k))
    return [(len(w), len(g), sha(" ".join(x for i, x in enumerate(w) if i not in g))) for w, g in zip(split, gone)]


def shared_lines(texts, ids, least=5, chars=40):
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    split = [(t or "").split("\n") for t in texts]
    holders = defaultdict(set)
    for d, lines in enumerate(split):
        for x in lines:
            if len(low(x)) >= chars:
                holders[low(x)].add(d)
    out = []
    rank = lambda d: (ids[d] is not None, ids[d] or 0)
    for d, lines in enumerate(split):
        kept = [x for x in lines if not (len(held := holders.get(low(x), ())) >= least and rank(d) != max(map(rank, held)))]
        out.append((len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def quality(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def alnum(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")


def contamination(texts, items):
    grams = defaultdict(set)
    for item, t in items:
        w = [x for x in alnum(t) if x]
        for i in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[i : i + 10])].add(item)
    out = []
    for t in texts:
        w = [x for x in alnum(t) if x]
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[g]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out
