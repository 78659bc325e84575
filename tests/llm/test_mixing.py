import random

from docflow.llm import mixing
from docflow.llm.common import Scratch


def test_a_sweep_over_few_cells_reads_its_input_once_and_gives_the_same(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 3000), r.choice(["en", "de", None]), r.choice("abc")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plans, keep = [], Scratch.keep

    def kept(self, df, name):
        if "factor" in str(df._jdf.queryExecution().analyzed()):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", kept)
    few = sorted(mixing.mix(docs).collect())
    assert plans and all(p.count("Relation [") == 1 and "Join" not in p for p in plans)
    plans.clear()
    assert sorted(mixing.mix(docs, broadcast_cells=0).collect()) == few and "Join" in plans[0]
