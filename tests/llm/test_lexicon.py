"""A rare insult is learnt, however many ordinary terms are in more toxic texts."""

import random

from mizan.llm import toxicity


def test_rare_insult_among_many_ordinary_terms(spark):
    rng = random.Random(2)
    ordinary = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(6000)})
    text = " ".join(ordinary)
    rows = [(text + (" zzinsultzz" if i < 8 else ""), 1) for i in range(10)] + [(text, 0)] * 30
    labelled = spark.createDataFrame(rows, "text string, label int").repartition(4)
    toxic = toxicity.term_counts(labelled.filter("label = 1")).filter("n >= 3")
    assert toxic.count() > 20_000
    lexicon = toxicity.learn_lexicon(labelled)
    assert toxicity.hash_of("zzinsultzz") in set(lexicon.terms.tolist())
    assert toxicity.hash_of(ordinary[0]) not in set(lexicon.terms.tolist())
