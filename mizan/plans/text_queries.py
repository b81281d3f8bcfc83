"""Registered queries of the inverted index and of phrases in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mizan.functions import text as T
from mizan.operators import phrases as P
from mizan.operators import settling
from mizan.operators.textindex import TextIndex
from mizan.session import new_folder, table

#: Searches by name: (word, exact) terms.
SEARCHES = {"one": [("th", False)], "two": [("le", False), ("de", False)], "exact": [("a", False), ("the", True)], "three": [("s", False), ("b", False), ("1", False)], "none": [("zzzz", False)]}


def index(s, d):
    return TextIndex.build(table(s, d, "documents"), "doc_id", "text", new_folder(s, "text-index"))


def searched(s, d):
    made = index(s, d)
    out = None
    for name, terms in SEARCHES.items():
        rows = made.search(terms).select(F.lit(name).alias("search"), F.col("id").alias("doc_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


_FORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({}, '')), '([\p{{L}}])([\p{{N}}])', '\1 \2', 'g'), '([\p{{N}}])([\p{{L}}])', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_FORM}, ' '), lambda x: x <> '')"
_HAS = lambda word, exact: f"list_contains(w, '{word}')" if exact else f"len(list_filter(w, lambda x: starts_with(x, '{word}'))) > 0"
SEARCHED_SQL = f"WITH d AS (SELECT doc_id, list_distinct({_WORDS.format('text')}) AS w FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS search, doc_id FROM d WHERE " + " AND ".join(_HAS(*t) for t in terms) for n, terms in SEARCHES.items())


def glossary(s, d):
    """What benchmark items begin with: their first one, two and three words; what they state is the item's number."""
    b = table(s, d, "benchmark").select("item_id", P.ordered_words(F.col("text")).alias("w"))
    some = b.select("item_id", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice("w", 1, n), " ")), lambda x: x != "")).alias("phrase"))
    return some.select("phrase", F.concat(F.lit("f"), (F.length("phrase") % 3).cast("string")).alias("fact"), F.col("item_id").cast("string").alias("value"), F.when(F.col("item_id") % 2 == 0, F.lit("not")).alias("otherwise"))


FACTS_SQL = f"""WITH RECURSIVE b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), g0 AS (SELECT item_id, array_to_string(w[1:n], ' ') AS phrase FROM b, (VALUES (1), (2), (3)) v(n) WHERE len(w) > 0),
g1 AS (SELECT phrase, 'f' || (length(phrase) % 3) AS fact, CAST(item_id AS VARCHAR) AS value, CASE WHEN item_id % 2 = 0 THEN 'not' END AS otherwise FROM g0),
g AS (SELECT phrase, fact, min(value) AS value, arg_min(otherwise IS NOT NULL, value) AS has FROM g1 GROUP BY 1, 2), names AS (SELECT DISTINCT phrase FROM g),
d AS (SELECT doc_id AS key, {_WORDS.format('text')} AS w FROM documents),
r AS (SELECT key, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS first FROM d, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n),
s AS (SELECT key, first, first + n - 1 AS last, phrase FROM (SELECT key, n, first, array_to_string(w[first:first + n - 1], ' ') AS phrase FROM r) JOIN names USING (phrase)),
l AS (SELECT key, first, max(last) AS last FROM s GROUP BY 1, 2),
k AS (SELECT key, min(first) AS first, arg_min(last, first) AS last FROM l GROUP BY 1 UNION ALL SELECT k.key, min(l.first), arg_min(l.last, l.first) FROM k JOIN l ON l.key = k.key AND l.first > k.last GROUP BY k.key),
o AS (SELECT k.key, k.first, k.last, w, coalesce(lag(k.last) OVER p, 0) AS before, coalesce(lead(k.first) OVER p, len(w) + 1) AS after FROM k JOIN d ON d.key = k.key WINDOW p AS (PARTITION BY k.key ORDER BY k.first)),
n AS (SELECT key, first, last, array_to_string(w[first:last], ' ') AS phrase, len(list_filter(w[greatest(before + 1, first - 3):first - 1], lambda x: x IN {P.NEGATES_NEXT})) > 0 OR len(list_filter(w[last + 1:least(after - 1, last + 3)], lambda x: x IN {P.NEGATES_LAST})) > 0 AS negated FROM o),
f AS (SELECT n.*, fact, CASE WHEN negated THEN CASE WHEN has THEN 'not' END ELSE value END AS value FROM n JOIN g USING (phrase))
SELECT key, fact, value, CAST(first AS INT) AS first, CAST(last AS INT) AS last, phrase, negated, min(value) OVER (PARTITION BY key, fact) = max(value) OVER (PARTITION BY key, fact) AS agreed FROM f WHERE value IS NOT NULL"""

#: Groups of words that a sentence's reading left over.
GROUPS = ["th", "le de", "zzzz", "s b"]
SUBSETS_SQL = f"WITH d AS (SELECT list_distinct({_WORDS.format('text')}) AS w FROM documents WHERE lang IN ('en', 'fr')) " + " UNION ALL ".join(
    f"SELECT CAST({k} AS INT) AS kept, count(*) AS n FROM d WHERE " + " AND ".join(["true", *[_HAS(w, False) for i, g in enumerate(GROUPS) if k >> i & 1 for w in g.split()]]) for k in range(1 << len(GROUPS))
)

QUERIES = {
    "qry26_subset_counts": (lambda s, d: settling.subset_counts(table(s, d, "documents"), F.col("lang").isin("en", "fr"), T.lexemes(F.col("text")), GROUPS), SUBSETS_SQL),
    "prd12_indexed_search": (searched, SEARCHED_SQL),
    "agg17_indexed_vocabulary": (lambda s, d: index(s, d).vocabulary(), f"WITH d AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents) SELECT word, count(*) AS df FROM d GROUP BY 1"),
    "ext15_stated_facts": (lambda s, d: P.stated_facts(table(s, d, "documents"), "doc_id", "text", glossary(s, d)), FACTS_SQL),
}
