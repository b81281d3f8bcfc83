"""An inverted index of texts: postings by word, so that a search reads the words it asks for instead of every text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.functions import text as T

#: Heads that words of other letters are dealt to, by hash of their first letter.
OTHERS = 16
#: First letters with a head of their own.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789آابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی"
#: Above every letter: the end of a range of words with one beginning.
LAST = "\U0010ffff"


def head(word: Column) -> Column:
    """The folder of a word, known from its first letter, so a prefix names it as well as a whole word."""
    first = F.substring(word, 1, 1)
    place = F.instr(F.lit(LETTERS), first)
    return F.when(place > 0, F.concat(F.lit("l"), place.cast("string"))).otherwise(F.concat(F.lit("o"), F.pmod(F.crc32(first.cast("binary")), F.lit(OTHERS)).cast("string")))


@dataclass(frozen=True)
class TextIndex:
    """Postings (head, word, id) under root: a folder a head, files sorted by word and id."""

    spark: SparkSession
    root: str
    id_type: str

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, root: str) -> TextIndex:
        """Write the index of docs(key, text): one row for each different word of each text, in the form that searches
        compare. Rows, not lists: a word that a third of all texts hold is spread over many files by its ids, and no task
        gathers it. Null and empty texts have no words. Rows that share a key are one text: its word stands once. An empty table: an empty index."""
        rows = docs.select(F.col(key).alias("id"), F.explode(T.lexemes(F.col(text))).alias("word")).withColumn("head", head(F.col("word")))
        place = ["head", "word", "id"]
        ordered = rows.repartitionByRange(*place).dropDuplicates(place).sortWithinPartitions(*place)  # equal rows are in one range
        ordered.write.partitionBy("head").parquet(root)
        return cls(docs.sparkSession, root, docs.schema[key].dataType.simpleString())

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, word string, head string").parquet(self.root)

    def vocabulary(self) -> DataFrame:
        """(word, df), from the postings alone; each stands once, so tasks send counts. A null id is no text."""
        return self.rows().groupBy("word").agg(F.count("id").alias("df"))

    def term(self, word: str, exact: bool) -> DataFrame:
        """(id) of texts with a word, or with any that begins so: one folder, and in it one range of words."""
        place = LETTERS.find(word[0]) + 1
        folder = F.lit(f"l{place}") if place else head(F.lit(word))
        hit = F.col("word") == word if exact else (F.col("word") >= word) & (F.col("word") < word + LAST)
        return self.rows().filter((F.col("head") == folder) & hit).select("id")

    def search(self, terms: list[tuple[str, bool]]) -> DataFrame:
        """(id) of the texts that hold all terms (word, exact): each term's texts once, and those that come as often as
        there are terms. No terms: every text with a word."""
        if not terms:
            return self.rows().select("id").distinct()
        each = [self.term(w, exact).distinct().withColumn("__t", F.lit(i)) for i, (w, exact) in enumerate(dict.fromkeys(terms))]
        every = each[0]
        for more in each[1:]:
            every = every.unionByName(more)
        return every.groupBy("id").agg(F.count("*").alias("__n")).filter(F.col("__n") == len(each)).select("id")
