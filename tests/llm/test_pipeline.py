"""The chain of corpus_pipeline.py on a small table with nulls, repeats and columns named like those of the stages."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mizan.llm import toxicity

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
CLASHES = ["score", "x", "features", "probability", "prediction", "even", "p", "rawPrediction", "kept0", "kept", "c0", "component_id", "leaks", "copies", "hash", "label", "shard", "n", "probe"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    say = lambda n, rude=0: " ".join(rng.choice(["idiot", "moron", "scum"]) if rng.random() < rude else rng.choice("stone river cloud garden paper window silver bridge orange valley".split()) + str(rng.randrange(40)) for _ in range(n))
    texts = {i: say(60, 0.4 if i % 6 == 0 else 0) for i in range(1, 120)}
    texts |= {200: texts[1], 201: texts[2] + " more", 202: None, 203: "", 204: " \n", 205: "one", 206: "word " * 3_000}
    item = say(12)
    texts |= {300: say(30) + " " + item + " " + say(30)}
    rows = [(i, t, "en" if i % 2 else None, f"src_{i % 4}" if i % 5 else None, len(t or "")) for i, t in texts.items()] + [(None, say(40), "en", "src_1", 1), (205, "one", "en", "src_1", 3)]
    at = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *[f"concat('{c}-', coalesce(doc_id, 0)) AS `{c}`" for c in CLASHES]).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(1, 120)] + [(999, 0, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_keep_columns_and_drop_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kinds = docs.columns, docs.dtypes
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == names and out.dtypes == kinds
        out.write.parquet(f"{folder}/stage{k}")
        before, docs = docs.collect(), spark.read.parquet(f"{folder}/stage{k}")
        after = docs.collect()
        assert not [r for r in after if r not in before]  # every value is as it was
        kept[name] = (before, after)
    ids = lambda rows: sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    # toxicity: as the operator scores the same rows, and rude texts go
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = toxicity.judge(spark, spark.read.parquet(f"{folder}/documents.parquet"), labels, reject=toxicity.REJECT).filter("predicted = 0").collect()
    assert ids(after) == ids(judged)
    assert {i for _, i in ids(after)}.isdisjoint({i for i in range(6, 120, 6)}) and len(after) > 90
    # near duplicates: the smallest id of each group, found by comparing all pairs
    before, after = kept["near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before if r.doc_id is not None}
    gone = {b for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert ids(after) == ids([r for r in before if r.doc_id not in gone]) and {200, 201} <= gone
    # decontamination
    before, after = kept["decontamination"]
    bench = [s for s in (shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()) if s]
    clean = [r for r in before if not any(10 * len(b & shingles(r.text)) >= 8 * len(b) for b in bench)]
    assert ids(after) == ids(clean) and 300 not in {r.doc_id for r in after}
    # mixing takes its budget, and each document once
    before, after = kept["mixing"]
    size = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert 0 < len(after) < len(before) and size(after) <= size(before) * 8 // 10
    # tokens
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(r.doc_id, zlib.crc32(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in after]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.ids_crc32)) for r in got)


def test_run_and_no_rows(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 10
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
