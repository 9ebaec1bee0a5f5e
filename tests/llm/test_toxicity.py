import random

from pyspark.sql import functions as F

from postpulse.llm import toxicity as tx

LABELS = "doc_id long, low_quality int, toxic int"


def corpus(n=300):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randint(0, 80)}" for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 7 == 0), int(toxic)))
    return rows, labels


def test_chain_finds_held_out_toxic_texts(spark, docs):
    rows, labels = corpus()
    rows += [(900, "you idiot go away"), (901, "a calm word3 text"), (902, None), (903, "")]
    held = spark.createDataFrame([x for x in labels if x[0] % 4], LABELS)
    chain = tx.fit_chain(spark, docs(rows).select("doc_id", "text"), held, ["low_quality", "toxic"])
    assert [x.category for x in chain.links] == ["low_quality", "toxic"]
    assert len(chain.links[1].earlier) == 1
    got = {r.doc_id: r.flagged for r in tx.score(docs(rows), chain).collect()}
    wrong = [i for i, _, t in labels if not i % 4 and got[i] != bool(t)]
    assert not wrong
    assert got[900] and not got[901] and not got[902] and not got[903]
    left = tx.reject(docs(rows), chain)
    assert left.columns == docs(rows).columns
    assert {r.doc_id for r in left.collect()} == {i for i, f in got.items() if not f}


def test_without_labels_or_with_one_class(spark, docs):
    rows, labels = corpus(40)
    text = docs(rows).select("doc_id", "text")
    none = tx.fit_chain(spark, text, spark.createDataFrame([], LABELS), ["low_quality", "toxic"])
    assert none.probabilities("idiot")[-1] < 1e-6
    same = spark.createDataFrame([(i, None if i == 1 else 0, 0) for i, _, _ in labels] + [(3, 0, 0)], LABELS)
    clean = tx.fit_chain(spark, text, same, ["low_quality", "toxic"])
    assert tx.score(docs(rows), clean).where("flagged").count() == 0
    assert tx.score(docs([]), clean).count() == 0


def test_sample_is_bounded(spark, docs):
    rows, labels = corpus(60)
    got = tx.training_rows(docs(rows).select("doc_id", "text"), spark.createDataFrame(labels, LABELS),
                           ["low_quality", "toxic"], 17)
    assert got.agg(F.count(F.lit(1))).first()[0] == 17
