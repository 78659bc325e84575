"""The whole pipeline held against plain Python over every document."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from test_decontaminate_brute import a_text, a_variant, brute
from test_native import WORD, measured
from tokenizers import Tokenizer

import corpus_pipeline
from docflow.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def good(text):
    text = text or ""
    n, chars, symbols, dup, repeated = measured(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    capitals = sum("A" <= c <= "Z" for c in text)
    bad = [n < 50, 100 * repeated > 50 * n, 10 * symbols > n, dup >= 2 and 100 * dup > 30 * lines, not 3 * n <= chars <= 10 * n, 100 * capitals > 40 * chars, 2 * text.count("!") > n]
    return not any(bad)


def shingles(text):
    words = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text)]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def first_of_each_group(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def drawn(rows):
    cell = {}
    for r in rows:
        n = len(WORD.findall(r[1]))
        form = next((name for name, most in mixing.FORMS if n < most), "book")
        cell[r[0]] = ({"source": r[3] or "(none)", "lang": r[2] or "(none)", "topic": form}, n)
    mass = defaultdict(float)
    for c, n in cell.values():
        mass[tuple(c[d] for d in mixing.DIMENSIONS)] += n
    whole = sum(mass.values())
    weight = {c: 1.0 for c in mass}
    target = []
    for k, d in enumerate(mixing.DIMENSIONS):
        totals = defaultdict(float)
        for c, m in mass.items():
            totals[c[k]] += m
        totals = {v: t ** mixing.TEMPER[d] for v, t in totals.items()}
        target.append({v: t / sum(totals.values()) for v, t in totals.items()})
    for _ in range(mixing.SWEEPS):
        off = 0.0
        for k in range(3):
            total = defaultdict(float)
            for c, m in mass.items():
                total[c[k]] += m / whole * weight[c]
            factor = {v: target[k][v] / t for v, t in total.items()}
            weight = {c: w * factor[c[k]] for c, w in weight.items()}
            off = max(off, *(abs(f - 1) for f in factor.values()))
        if off <= 1e-9:
            break
    most = max(weight.values())
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    return [r for r in rows if draw(r[0]) < round(weight[tuple(cell[r[0]][0][d] for d in mixing.DIMENSIONS)] / most, 9)]


def encoded(rows):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out, start = set(), 0
    for r in sorted(rows):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
        out.add((r[0], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def fixture(r):
    vocabulary = [f"{a}{b}{c}{d}" for a in "bcdfgl" for b in "aeiou" for c in "klmnp" for d in ("", "ta", "é")]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, a_text(r, r.choice([12, 20, 40]))) for i in range(12)]
    texts = [say(r.choice([60, 120, 200, 400, 700, 2100])) for _ in range(70)]
    for t in texts[:25]:
        words = t.split(" ")
        for _ in range(r.randint(1, 3)):
            # Copies: exact, recased, and changed in so many words that some are over the threshold and some are not.
            for at in r.sample(range(len(words)), r.choice([0, 1, 1, 2, 3])):
                words[at] = "changed"
            texts.append(r.choice([" ".join(words), " ".join(words).upper().lower(), "  ".join(words).capitalize()]))
    texts += [say(50) + " " + a_variant(r, r.choice(items)[1]) + " " + say(50) for _ in range(30)]
    texts += [None, "", "too short", "%% ## " * 100, "the same three words " * 40, say(60).upper(), "\n".join([say(12)] * 9)]
    r.shuffle(texts)
    return [(3 * i, t, r.choice(["en", "en", "en", "fr", None]), r.choice("aaab"), len(t or "")) for i, t in enumerate(texts)], items


def test_run_equals_brute_force(spark, tmp_path):
    rows, items = fixture(random.Random(21))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [r for r in rows if good(r[1])]
    single = first_of_each_group(clean)
    held = {d for d, *_, consistent in brute([r[:2] for r in single], items) if consistent}
    left = [r for r in single if r[0] not in held]
    mixed = drawn(left)
    assert len(rows) > len(clean) > len(single) > len(left) > len(mixed) > 5
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {tuple(x[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for x in got.collect()} == encoded(mixed)
