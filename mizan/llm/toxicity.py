"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read
from mizan.llm.words import BASE, IS_SPACE, LOWER, U, Words, buffers, mix, pieces, scan

#: Words known as insults before any label is seen; all others are learnt.
SEEDS = ("asshole", "bastard", "bitch", "clown", "crap", "disgusting", "dumb", "filth", "fool", "freak", "garbage", "hate", "idiot", "imbecile", "jerk", "kill", "loser", "moron", "pathetic", "pig", "retard", "scum", "shit", "shut", "stupid", "sucker", "trash", "ugly", "vermin", "worthless")
#: Words that address the reader, in the corpus's languages.
YOU = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vos", "vosotros", "su")
#: Bytes of a word's beginning that are lexicon terms of their own: stems of inflected insults.
STEMS = (4, 5, 6, 7)
#: Bound of what is fitted on: labelled rows.
MAX_LABELLED = 200_000
#: The decision threshold on the calibrated score.
REJECT = 0.3
FEATURES = ("hits", "hit_rate", "weight_rate", "heaviest", "distinct", "stem_hits", "stem_rate", "densest", "near_you", "you_rate", "near_rate", "capitals", "shouted", "exclaims", "questions", "punctuation", "repeated", "obfuscated", "symbols", "digits", "stretched", "word_length", "log_words")

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = ~LETTER & ~DIGIT & ~IS_SPACE
#: What stands for a letter inside a word.
LEET = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip("013457@$!|", "oieastasil", strict=True):
    LEET[ord(_sign)] = ord(_letter)


def plain_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner, read_as, keep): signs and digits between letters, bytes with these read as the letters they stand for, and
    which bytes are left once punctuation is gone."""
    letter = LETTER[raw]
    inner = ~letter & ~IS_SPACE[raw]
    inner[:1] = inner[-1:] = False
    inner[1:-1] &= letter[:-2] & letter[2:]
    read_as = np.where(inner, LEET[raw], raw)
    return inner, read_as, ~MARK[raw] | (inner & LETTER[read_as])


def plain_words(column: pa.Array) -> Words:
    """Words without punctuation, signs inside a word read as the letters they stand for."""
    raw, at = buffers(column)
    _, read_as, keep = plain_bytes(raw)
    return scan(LOWER[read_as[keep]], np.concatenate([[0], np.cumsum(keep)])[at], STEMS)


def counted_words(column: pa.Array) -> tuple[Words, dict[str, np.ndarray]]:
    """plain_words, and counts of bytes by text."""
    raw, at = buffers(column)
    n = len(raw)
    inner, read_as, keep = plain_bytes(raw)
    letter, mark, digit = LETTER[raw], MARK[raw], DIGIT[raw]
    upper = (raw >= 65) & (raw <= 90)
    same = np.zeros(n, bool)
    same[1:] = raw[1:] == raw[:-1]
    third = np.zeros(n, bool)
    third[1:] = same[1:] & same[:-1]

    def by_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

    counts = {"bytes": np.diff(at), "letters": by_text(letter), "upper": by_text(upper), "digits": by_text(digit), "marks": by_text(mark), "exclaims": by_text(raw == 33), "questions": by_text(raw == 63), "repeated": by_text(same & mark), "obfuscated": by_text(inner & (raw != 39) & (raw != 45)), "symbols": by_text(np.isin(raw, np.frombuffer(b"#$%&*@^~", np.uint8))), "stretched": by_text(third & letter)}
    to = np.concatenate([[0], np.cumsum(keep)])
    w = scan(LOWER[read_as[keep]], to[at], STEMS)
    shout = np.concatenate([[0], np.cumsum(upper[keep])])
    length = w.ends - w.starts
    caps = (shout[w.ends] - shout[w.starts] == length) & (length > 1)
    counts["shouted"] = np.diff(np.concatenate([[0], np.cumsum(caps)])[w.first])
    return w, counts


def hash_of(word: str, stem: int = 0) -> int:
    w = scan(LOWER[np.frombuffer(word.encode(), np.uint8)], np.array([0, len(word.encode())]), (stem,) if stem else ())
    return int(w.prefixes[stem][0] if stem else w.hashes[0])


@dataclass
class Lexicon:
    """Sorted term hashes and their weights; you: hashes of the words that address the reader."""

    terms: np.ndarray
    weights: np.ndarray
    you: np.ndarray = field(default_factory=lambda: np.sort(np.array([hash_of(x) for x in YOU], np.uint64)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Weight of each hash, 0 if it is no term."""
        if not len(self.terms):
            return np.zeros(len(hashes))
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, self.weights[i], 0.0)


def dense(column: pa.Array, lexicon: Lexicon, window: int = 40, reach: int = 3) -> np.ndarray:
    """One row of FEATURES for each text; zeros where there are no words."""
    w, c = counted_words(column)
    texts, n = len(w.first) - 1, np.diff(w.first)
    text = w.text_of
    exact = lexicon.of(w.hashes)
    stem = np.zeros(len(w.hashes))
    for k in STEMS:
        np.maximum(stem, lexicon.of(w.prefixes[k]), out=stem)
    weight = np.maximum(exact, stem)
    hit, stem_hit = weight > 0, (stem > 0) & (exact == 0)
    you = np.isin(w.hashes, lexicon.you)

    def total(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])

    def around(flags: np.ndarray, left: int, right: int) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags)])
        i = np.arange(len(flags))
        lo = np.maximum(i - left, w.first[:-1][text])
        hi = np.minimum(i + right + 1, w.first[1:][text])
        return run[hi] - run[lo]

    def most(x: np.ndarray) -> np.ndarray:
        out = np.zeros(texts)
        some = n > 0
        if some.any():
            out[some] = np.maximum.reduceat(x, w.first[:-1][some])
        return out

    first_hit = np.zeros(len(weight), bool)
    if hit.any():
        at = np.flatnonzero(hit)
        pair = mix(w.hashes[at] ^ mix(text[at].astype(np.uint64) + U(1)))
        first_hit[at[np.unique(pair, return_index=True)[1]]] = True
    per = np.maximum(n, 1)
    size = np.maximum(c["bytes"], 1)
    hits, stems, close, yous = total(hit), total(stem_hit), total(hit & (around(you, reach, reach) > 0)), total(you)
    columns = (hits, hits / per, total(weight) / per, most(weight), total(first_hit), stems, stems / per, most(around(hit, 0, window)), close, yous / per, close / per, c["upper"] / np.maximum(c["letters"], 1), c["shouted"] / per, c["exclaims"] / per, c["questions"] / per, c["marks"] / size, c["repeated"] / size, c["obfuscated"] / per, c["symbols"] / per, c["digits"] / size, c["stretched"] / per, total(w.ends - w.starts) / per, np.log1p(n))
    return np.stack(columns, axis=1).astype(np.float64)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many texts each term (a word, or a word's stem) is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = plain_words(part.column("text"))
                salt = mix(w.text_of.astype(np.uint64) + U(1))
                for hashes in (w.hashes, *[w.prefixes[k] for k in STEMS]):
                    some = np.flatnonzero(hashes)
                    _, i = np.unique(mix(hashes[some] ^ salt[some]), return_index=True)  # once for each text
                    term, n = np.unique(hashes[some[i]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(labelled: DataFrame, least: int = 3, evidence: float = 20.0) -> Lexicon:
    """Terms that labelled(text, label) ties to label 1: log-odds (smoothed) over 1.5, and a likelihood ratio (G2) that
    chance hardly gives. All terms are judged where they are counted; those that pass are collected, as many as the
    labelled sample has."""
    size = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    seeds = {hash_of(x): 3.0 for x in SEEDS}
    if toxic and clean:
        often = term_counts(labelled.filter("label = 1")).filter(F.col("n") >= least).select("term", F.col("n").alias("a"))
        both = often.join(term_counts(labelled.filter("label = 0")).select("term", F.col("n").alias("b")), "term", "left").select("term", "a", F.coalesce("b", F.lit(0)).alias("b"))
        a, b, share = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / (toxic + clean)
        odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
        g2 = 2 * (a * F.log(a / (toxic * share)) + F.when(b > 0, b * F.log(b / (clean * share))).otherwise(0.0))
        tied = both.select("term", odds.alias("odds"), g2.alias("g2")).filter((F.col("odds") > 1.5) & (F.col("g2") >= evidence)).select("term", "odds").toPandas()
        for term, weight in zip(tied["term"].to_numpy(np.int64).view(np.uint64).tolist(), tied["odds"].tolist(), strict=True):
            seeds[term] = max(seeds.get(term, 0.0), min(weight, 8.0))
    terms = np.array(sorted(seeds), np.uint64)
    return Lexicon(terms, np.array([seeds[int(t)] for t in terms]))


def features(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """The kept columns and `features`, a vector."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([docs.schema[k] for k in keep] + [StructField("x", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = dense(part.column("text"), lexicon)
                at = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], [*keep, "x"])

    return docs.select(*keep, *[c for c in ("text",) if c not in keep]).mapInArrow(run, schema).withColumn("features", array_to_vector("x")).drop("x")


def in_fold(column: str, folds: int, fold: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


@dataclass
class Model:
    """A fitted classifier; trees and curve are None where there was too little to learn from: then prior is the score."""

    lexicon: Lexicon
    trees: object | None
    curve: object | None
    prior: float

    def score(self, docs: DataFrame, *keep: str, name: str = "score") -> DataFrame:
        """The kept columns as they are, whatever their names, and the score under a name that is none of theirs."""
        assert name.lower() not in {c.lower() for c in keep}, f"{name} is a kept column"
        own = [f"kept{i}" for i in range(len(keep))]  # so none of the model's own columns meets the caller's
        base = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(own, keep, strict=True)], F.col("text"))
        known = features(base, self.lexicon, *own)
        back = [F.col(k).alias(c) for k, c in zip(own, keep, strict=True)]
        if self.trees is None:
            rate = vector_to_array("features")[FEATURES.index("hit_rate")]
            return known.select(*back, F.greatest(F.lit(self.prior) * 0.2, 1 - F.exp(-100.0 * rate)).alias(name))
        raw = self.trees.transform(known).withColumn("p", vector_to_array("probability")[1])
        even = self.curve.transform(raw.drop("features", "prediction")).withColumnRenamed("prediction", "even")
        # the curve has flat parts; a thousandth of the trees' own order breaks ties within them
        return even.select(*back, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("even") + 0.001 * F.col("p"))).alias(name))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, rounds: int = 20, depth: int = 4, least: int = 40) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, label), all of which are learnt from.

    Bounded sample: max_labelled labelled ids, those with the least hash, where there are more. A quarter of them, by
    another hash, calibrates (isotonic regression on the trees' probability); the rest gives lexicon and trees. Repeated
    labels: the largest; null labels and labels without a document are left out. Below `least` rows, or with one class
    alone, no trees are grown: the score is then the share of lexicon hits.
    """
    some = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    tmp = Scratch(spark, "toxicity")
    drawn = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # max_labelled rows at most
    labelled = tmp.keep(drawn.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0), "labelled")
    lexicon = learn_lexicon(labelled.filter("not calibrates"))
    counts = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones"), F.coalesce(F.sum(F.when(~F.col("calibrates"), F.col("label"))), F.lit(0)).alias("fit1"), F.coalesce(F.sum(F.when(~F.col("calibrates"), 1 - F.col("label"))), F.lit(0)).alias("fit0"), F.coalesce(F.sum(F.when(F.col("calibrates"), 1)), F.lit(0)).alias("cal")).first()
    prior = (counts["ones"] + 1) / (counts["n"] + 2)
    if counts["n"] < least or not counts["fit1"] or not counts["fit0"] or not counts["cal"]:
        return Model(lexicon, None, None, prior)
    ready = features(labelled.withColumn("label", F.col("label").cast("double")), lexicon, "doc_id", "label", "calibrates")
    ready = tmp.keep(ready.withColumn("x", vector_to_array("features")).drop("features"), "features").withColumn("features", array_to_vector("x")).drop("x")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=11).fit(ready.filter("not calibrates"))
    held = trees.transform(ready.filter("calibrates")).select("label", vector_to_array("probability")[1].alias("p"))
    curve = IsotonicRegression(labelCol="label", featuresCol="p").fit(held)
    tmp.drop("labelled", "features")
    return Model(lexicon, trees, curve, prior)


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text), labels(doc_id, toxic) marking some.

    Learns only from labels of ids whose crc32 as text leaves no remainder 2 by 4. Inputs of a score are the text's
    features alone: lexicon densities, second-person proximity, capitals, punctuation, obfuscation. Null and empty texts
    are scored like any other, on features that are zero; repeated rows get equal scores; a null doc_id is scored and
    never learnt from; other columns are not looked at; an empty table gives no rows.
    """
    learnt = labels.filter(~in_fold("doc_id", 4, 2)).select("doc_id", F.col("toxic").alias("label"))
    model = fit(spark, docs, learnt)
    base = docs.select("doc_id", "text")
    return model.score(base, "doc_id").select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
