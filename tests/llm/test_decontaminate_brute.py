"""Decontamination held against plain loops over every document and item."""

import random
from collections import Counter, defaultdict

import regex

from docflow.llm import decontaminate as D

SLOTS = D.NUMBER + D.NAME + D.UNIT
WIDTH, PERCENT, RUN = D.WIDTH, D.PERCENT, D.RUN


def python_pattern(pattern):
    return regex.sub(r"\\x\{([0-9a-f]{4})\}", r"\\u\1", pattern)


def tokens(text):
    """Slot tokens of a text: a placeholder and its value, or a word."""
    for pattern, new in D.STEPS:
        text = regex.sub(python_pattern(pattern), regex.sub(r"\$(\d)", r"\\\1", new), text)
    return regex.sub(python_pattern(D.JUNK), " ", text.upper().lower()).strip(" ").split(" ")


def plain(token):
    return "".join(c for c in token if c not in SLOTS)


def template(token):
    return token[0] if token[0] in SLOTS else token


def folded(token):
    return plain(token) if token[0] == D.NAME else template(token)


def folded_window(window):
    f = tuple(map(folded, window))
    return tuple(map(plain, window)) if 2 * sum(x not in (D.NUMBER, D.UNIT) for x in f) < WIDTH else f


def windows_of_item(own):
    """(i, window) to (it is a template window, it is a case-folded one)."""
    if len(own) < WIDTH:
        return {(0, tuple(map(plain, own))): (0, 1)}
    found = {}
    for i in range(len(own) - WIDTH + 1):
        w = own[i : i + WIDTH]
        t, f = tuple(map(template, w)), folded_window(w)
        literal = 2 * sum(x not in SLOTS for x in t) >= WIDTH
        found[i, f] = (int(literal and t == f), 1)
        if literal and t != f:
            found[i, t] = (1, 0)
    return found


def places(shift):
    return [(1, shift), *[(size, by, (shift + by) // size) for size in D.RANGES for by in (0, size // 2)], "whole"]


def enough(s, n):
    best = max((s[k] / n[k], s[k], n[k]) for k in (0, 1) if n[k])
    whole = 100 * best[1] >= PERCENT * best[2]
    return (best[1], best[2], whole) if whole or s[1] > RUN - WIDTH else None


def longest_run(laid, item, doc):
    most, before, many = 0, None, 0
    for i, shift in laid:
        if list(map(plain, item[i : i + WIDTH])) != list(map(plain, doc[i + shift : i + shift + WIDTH])):
            continue
        many = many + 1 if before == (i - 1, shift) else 1
        before, most = (i, shift), max(most, many)
    return most + WIDTH - 1


def judge(doc, item):
    """(consistent, share, n_shared, n_windows, n_slots) of the best place, or None."""
    mine = windows_of_item(item)
    n = [sum(v[k] for v in mine.values()) for k in (0, 1)]
    at = defaultdict(set)
    for (i, w), kinds in mine.items():
        at[w].add((i, kinds))
    kinds_at = defaultdict(lambda: (0, 0))
    for size in {WIDTH, min(WIDTH, len(item))}:
        for d in range(len(doc) - size + 1):
            w = doc[d : d + size]
            for made in {tuple(map(template, w)), folded_window(w)} if size == WIDTH else {tuple(map(plain, w))}:
                for i, (t, f) in at.get(made, ()):
                    kinds_at[i, d - i] = (max(kinds_at[i, d - i][0], t), max(kinds_at[i, d - i][1], f))
    by_window = defaultdict(lambda: (0, 0))
    for (i, _), (t, f) in kinds_at.items():
        by_window[i] = (max(by_window[i][0], t), max(by_window[i][1], f))
    if not by_window or not enough([sum(v[k] for v in by_window.values()) for k in (0, 1)], n):
        return None
    votes = Counter(shift for _, shift in kinds_at)
    best = {}
    for i, shift in kinds_at:
        for place in places(shift):
            key = (place, i)
            if key not in best or (votes[shift], -shift) > (votes[best[key]], -best[key]):
                best[key] = shift
    results = []
    for place in {p for p, _ in best}:
        laid = sorted((i, shift) for (p, i), shift in best.items() if p == place)
        good = enough([sum(kinds_at[w][k] for w in laid) for k in (0, 1)], n)
        if not good:
            continue
        shared, many, whole = good
        run = sum(kinds_at[w][1] for w in laid) > RUN - WIDTH and longest_run(laid, item, doc) >= RUN
        if not (whole or run):
            continue
        slots = {(item[k], plain(doc[k + shift])) for i, shift in laid for k in range(i, min(i + WIDTH, len(item))) if item[k][0] in SLOTS}
        results.append((run or (whole and len(slots) == len({v for v, _ in slots})), shared / many, shared, many, len(slots)))
    return max(results, default=None)


def brute(docs, items):
    found = {}
    texts = [(i, tokens(t)) for i, t in items if i is not None and t]
    for doc_id, text in docs:
        if doc_id is None or not text:
            continue
        doc = tokens(text)
        for item_id, item in texts:
            if item == [""] or doc == [""]:
                continue
            got = judge(doc, item)
            if got and got > found.get((doc_id, item_id), ()):
                found[doc_id, item_id] = got
    return {(*k, v[2], v[3], v[4], v[0]) for k, v in found.items()}


def a_text(r, n):
    words = "the of a train river asks how many then adds over hill she they walk about small green".split()
    kinds = [lambda: r.choice(words)] * 6 + [lambda: str(r.randint(1, 40)), lambda: f"{r.randint(1, 40)} {r.choice(['km', 'kg', 'hours'])}", lambda: r.choice(["Peter", "Maria", "Rome", "Oslo"])]
    return "".join(r.choice(kinds)() + r.choice([" ", " ", " ", " ", ", ", ". ", " - "]) for _ in range(n)).strip()


def a_variant(r, text):
    """The text as a copy might have it: other values, letter case, words put in or left out."""
    words = text.split(" ")
    swap = {w: str(r.randint(50, 99)) for w in words if w.isdigit()}
    at = r.randrange(len(words))
    made = [
        lambda: words,
        lambda: [swap.get(w, w) for w in words],
        lambda: [str(r.randint(50, 99)) if w.isdigit() and r.random() < 0.3 else w for w in words],
        lambda: words[:at] + ["quite", "so"] + words[at:],
        lambda: words[:at] + words[at + 1 :],
        lambda: words[: max(1, at)],
        lambda: [w.upper() for w in words],
        lambda: [w.title() for w in words],
        lambda: words[at:] + words[:at],
    ]
    return " ".join(r.choice(made)())


def test_contamination_equals_brute_force(spark):
    r = random.Random(11)
    items = [(i, a_text(r, r.choice([1, 3, 6, 8, 9, 14, 30, 60]))) for i in range(24)]
    items += [(3, a_text(r, 20)), (100, None), (101, ""), (102, "?!"), (None, "the river asks how many"), items[5]]
    texts = [t for i, t in items if i is not None and t]
    docs = []
    for k in range(120):
        parts = [a_text(r, r.randint(1, 30)) for _ in range(2)] + [a_variant(r, r.choice(texts)) for _ in range(r.randint(0, 3))]
        r.shuffle(parts)
        docs.append((k, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "?! --"), (None, texts[7]), docs[9], (4, texts[9]), (203, " ".join(texts) + " word" * 5000)]
    made = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    want = brute(docs, items)
    got = {(x["doc_id"], x["item_id"], x["n_shared"], x["n_windows"], x["n_slots"], x["consistent"]) for x in D.contamination(made, bench).collect()}
    assert got == want
    assert sum(w[-1] for w in want) > 50 and sum(not w[-1] for w in want) > 5
    held = {(x["doc_id"], x["n_items"], x["item_id"]) for x in D.contaminated(made, bench).collect()}
    by_doc = defaultdict(list)
    for w in want:
        if w[-1]:
            by_doc[w[0]].append(w[1])
    assert held == {(k, len(v), min(v)) for k, v in by_doc.items()}
