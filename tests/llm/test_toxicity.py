import random
import zlib

import numpy as np

from lakeloom.llm import toxicity

G = toxicity.Grammar({}, toxicity.PRIOR)


def reading(text):
    return [r for r, x in zip(toxicity.READINGS, G.features(text), strict=False) if x]


def test_readings():
    assert reading("What an idiot.") == ["plain"]
    assert reading("You are an idiot. Fine day") == ["targeted"]
    assert reading("idiot, you") == ["targeted"]
    assert reading("He is not an idiot") == ["negated"]
    assert reading("She said you are an idiot") == ["reported"]
    assert reading("They said no. You idiot!") == ["targeted"]
    assert reading("I will kill you") == ["threat_targeted"]
    assert reading("kill the lights") == ["threat"]
    assert reading("You are kind. Nice") == [] and reading("") == []
    assert G.score(G.features("You are stupid scum, a worthless loser")) > 0.5 > G.score(G.features("he said it was not trash"))


def test_table_is_the_composition():
    """The compiled table reads random symbol strings as the five parts do one by one."""
    random.seed(5)
    for _ in range(300):
        state, targeted, negated, reported = 0, False, 0, False
        for _ in range(12):
            x = random.choice(toxicity.SYMBOLS)
            want = -1
            if x in ("insult", "threat"):
                want = 3 if reported else 2 if negated else (4 if x == "threat" else 0) + targeted
            assert toxicity.MARKS[state][toxicity.SYMBOLS.index(x)] == want
            state = toxicity.MOVES[state][toxicity.SYMBOLS.index(x)]
            targeted, reported = (x == "target" or targeted) and x != "end", (x == "report" or reported) and x != "end"
            negated = 0 if x == "end" else 3 if x == "negation" else max(0, negated - 1)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in rows.doc_id)
    y, s = rows.toxic.to_numpy(), rows.score.to_numpy()
    hits = ((s >= 0.5) & (y == 1)).sum()
    precision, recall = hits / max(1, (s >= 0.5).sum()), hits / y.sum()
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    print("precision", precision, "recall", recall, "auc", auc)
    assert precision > 0.85 and recall > 0.6 and auc > 0.8


def test_edge_cases(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    grammar = toxicity.fit(hard, labels)
    rows = toxicity.score(hard, grammar).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(hard, grammar).columns == hard.columns
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert np.allclose(toxicity.fit_weights(np.zeros((0, 7)), np.zeros(0)), toxicity.PRIOR)
