r"""Postings: which documents hold a piece of text, looked up by equality instead of compared with every query.

A phrase is two neighbouring terms of a query, and it is looked for as a
substring, so "art her" stands in "smart heron".  Its terms have three letters
or more, hence it stands in a text exactly if two neighbouring tokens end and
begin with its terms, and those tokens then agree with it in the three letters
before and after the space.  These seven characters are the key: documents give
one posting per distinct pair of tokens, queries one per phrase, equal keys
meet, and the meeting is verified on the whole terms.

Defined cases: null texts have no tokens; a query of fewer than two terms has no
phrase; tokens of fewer than three letters give no posting, as no phrase can
begin or end in them; rows that repeat a doc_id count once; an empty side gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import adjacent_pairs, alnum_tokens, let, meaningful_terms

#: Letters of a term before and after the space that make the key.
SIDE = 3
#: Phrases of the queries that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _key(left: Column, right: Column) -> Column:
    return F.concat(F.substring(left, -SIDE, SIDE), F.lit(" "), F.substring(right, 1, SIDE))


def token_pairs(text: Column) -> Column:
    """Distinct neighbouring tokens of a text that a phrase could stand in, with a space between."""

    def pairs(t: Column) -> Column:
        n = F.size(t)
        long = lambda x: F.length(x) >= SIDE
        both = F.zip_with(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(t, F.lit(2), n), lambda a, b: F.when(long(a) & long(b), F.concat(a, F.lit(" "), b)))
        return F.array_distinct(F.array_compact(both))

    return let(alnum_tokens(text), pairs)


def phrase_postings(docs: DataFrame) -> DataFrame:
    """key, l, r, doc_id: one row for each distinct pair of neighbouring tokens of a document."""
    pairs = docs.select("doc_id", F.explode(token_pairs(F.col("text"))).alias("p"))
    pairs = pairs.select(F.substring_index("p", " ", 1).alias("l"), F.substring_index("p", " ", -1).alias("r"), "doc_id")
    return pairs.select(_key(F.col("l"), F.col("r")).alias("key"), "l", "r", "doc_id")


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, key, a, b: the phrases of each query (query_id, text)."""
    phrases = queries.select("query_id", F.explode(F.array_distinct(adjacent_pairs(meaningful_terms(F.col("text"))))).alias("p"))
    phrases = phrases.select("query_id", F.split("p", " ").alias("p")).select("query_id", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))
    return phrases.withColumn("key", _key(F.col("a"), F.col("b")))


def match(postings: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, doc_id, once each, where a phrase of the query stands in the document."""
    asked = F.broadcast(phrases) if phrases.count() <= BROADCAST_ROWS else phrases
    met = postings.join(asked, "key").where(F.col("l").endswith(F.col("a")) & F.col("r").startswith(F.col("b")))
    return met.select("query_id", "doc_id").distinct()


class PhraseIndex:
    """Postings written once, sorted by key, and dealt into ranges of keys: a search reads the row groups of its keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> PhraseIndex:
        # the document is part of the range, so one common pair is spread over files
        postings = phrase_postings(docs).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
        postings.write.mode("overwrite").parquet(path)
        return cls(docs.sparkSession, path)

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id where two neighbouring terms of the query stand in the document."""
        postings = self.spark.read.schema("key string, l string, r string, doc_id long").parquet(self.path)
        phrases = query_phrases(queries)
        first, last = phrases.agg(F.min("key"), F.max("key")).head()
        if first is None:
            return match(postings.limit(0), phrases)
        return match(postings.where(F.col("key").between(first, last)), phrases)
