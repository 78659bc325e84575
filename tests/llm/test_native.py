import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docflow.llm import mixing as M
from docflow.llm import quality as Q
from docflow.llm.decontaminate import contaminated, contamination

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {k for i, w in enumerate(windows) if many[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_equals_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "é🎉", "c#", "THE", "x\ny", "\t", "d|"]) for _ in range(r.randint(0, 90))) for _ in range(60)] + [None, "", "\n\n", "a a a a", "a\na\n \na", "x" * 5000, "word " * 60_000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words long")
    ledger = Q.stored_ledger(docs)
    rows = Q.apply_policy(ledger).orderBy("doc_id").collect()
    assert [(x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in rows] == [measured(t) for t in texts]
    for x in rows:
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]) and not (x["base_failed"] and x["kept"])
    kept = {x["doc_id"] for x in rows if x["kept"]}
    assert {x["doc_id"] for x in Q.kept_rows(docs).collect()} == kept and Q.kept_rows(docs).columns == docs.columns
    parts = {a["rule"]: a for a in Q.ablations(ledger).collect()}
    for rule, a in parts.items():
        rest = Q.mask([p for p in Q.POLICIES["v1"] if p != rule])
        assert a["kept"] == len(kept) and a["kept_without"] == sum(1 for x in rows if not x["fail_bits"] & rest)
    assert Q.ledger(docs.limit(0)).count() == 0


ITEM = "A train leaves the old Station with 120 km to go and then the driver named Peter stops for 30 minutes before it moves at 120 km again until night falls over the hills"


def test_templates(spark):
    swap = ITEM.replace("120", "95").replace("Peter", "Maria").replace("30", "45")
    uneven = ITEM.replace("120", "95", 1)
    rows = [(1, "Intro text here. " + ITEM + " and more words follow"), (2, "x " + swap), (3, "y " + uneven), (4, "nothing of the kind " * 20), (5, None), (6, ""), (7, ITEM.upper().lower()), (1, "again")]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM, 0), (11, "1 2 3 4 5 6 7 8 9 10", 0), (12, None, 0), (13, "a totally different benchmark question about the length of rivers and the height of mountains", 0)], "item_id long, text string, doc_id long")
    pairs = {(r["doc_id"], r["item_id"]): r for r in contamination(docs, items).collect()}
    assert pairs[1, 10]["consistent"] and pairs[2, 10]["consistent"] and not pairs[3, 10]["consistent"]
    assert {r["doc_id"] for r in contaminated(docs, items).collect()} == {1, 2, 7}
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_every_place_is_judged(spark):
    uneven = ITEM.replace("120", "95", 1)
    inserted = ITEM.replace("named Peter", "whom they all named Peter").replace("120", "95")
    rows = [(1, "Intro " + uneven + " and then a copy " + ITEM), (2, ITEM[:90] + " stop. " + uneven + " more. " + ITEM), (3, inserted), (4, uneven + " and " + uneven)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (10, "some other text under the same id that is long enough to have windows")], "item_id long, text string")
    assert {r["doc_id"] for r in contaminated(docs, items).collect()} == {1, 2, 3}


def test_letter_case_hides_no_copy(spark):
    listed = "Of Anna, Boris, Carla, Dieter, Emma, Franz, Greta, Hugo, Irma and Jens the oldest lives in Straße 5, the next in Weg 7, says Karl, who knows them all; Anna left"
    copies = [f(t) for t in (ITEM, listed) for f in (str.upper, str.title, str.lower, lambda t: t.upper().lower())]
    docs = spark.createDataFrame([(i, "Some words before it. " + t + " AND SOME AFTER") for i, t in enumerate(copies)] + [(7, ITEM.upper().lower()), (90, ITEM.upper().replace("120", "95", 1))], "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, listed)], "item_id long, text string")
    assert {r["doc_id"] for r in contaminated(docs, items).collect()} == set(range(len(copies)))


def test_no_item_is_left_out(spark):
    sums = "12 + 7 = 19; 19 + 30 = 49; 49 - 8 = 41; 41 * 2 = 82; 82 / 2 = 41 kg"
    long = " ".join(f"{a}{b}" for a in "abcdef" for b in "klmnopqrst")
    rows = [(1, "see " + sums + " there"), (2, "as they say: who wrote the Iliad? Nobody knows it for sure"), (3, "zz " + " ".join(long.split()[10:40]) + " zz"), (4, sums.translate(str.maketrans("123456789", "234567891"))), (5, " ".join(long.split()[10:38])), (6, "who wrote it, the Iliad"), (7, "???")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, sums), (11, "Who wrote the Iliad?"), (12, long), (13, "?!"), (14, "NOBODY knows it for")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contamination(docs, items).where("consistent").collect()} == {(1, 10), (2, 11), (2, 14), (3, 12)}


def test_mixing_meets_the_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([3, 160, 700])), r.choice(["en", "en", "en", "fr", None]), r.choice("abbb"), "z") for i in range(300)] + [(300, None, "en", "a", "z"), (301, "", None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability string")
    out = M.mix(docs).toPandas()
    assert len(out) == len(rows) and out["probability"].between(0, 1).all()
    whole = (out["n_tokens"] * out["probability"]).sum()
    for d, power in M.TEMPER.items():
        share = out.groupby(d)["n_tokens"].sum()
        share = share[share > 0] ** power
        got = (out["n_tokens"] * out["probability"]).groupby(out[d]).sum() / whole
        assert ((share / share.sum() - got[share.index]).abs() < 0.01).all()
    again = M.mix(docs.repartition(5)).toPandas()
    assert set(out[out["sampled"]]["doc_id"]) == set(again[again["sampled"]]["doc_id"])
    assert M.mix(docs.limit(0)).count() == 0


def test_given_targets(spark):
    docs = spark.createDataFrame([(i, "one two", "en", "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, lang string, source string")
    even = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, target double")
    out = M.mix(docs, targets={"source": even}).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("t")).collect()
    assert abs(out[0]["t"] - out[1]["t"]) < 1e-6


def test_missed_targets_are_reported(spark, caplog):
    docs = spark.createDataFrame([(i, "one two", "en" if i < 50 else "fr", "a" if i < 50 else "b") for i in range(100)], "doc_id long, text string, lang string, source string")
    tied = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("en", 0.1), ("fr", 0.9)], "lang string, target double")}
    with caplog.at_level("INFO", "docflow.llm.mixing"):
        M.mix(docs).count()
        assert "not met" not in caplog.text and "sets the scale" in caplog.text
        M.mix(docs, targets=tied, sweeps=2).count()
        assert "not met" in caplog.text
