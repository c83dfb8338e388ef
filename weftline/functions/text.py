"""Text scalars as Column builders; everything stays inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
QUERY_STOPWORDS = (
    "a", "an", "are", "about", "based", "do", "does", "for", "from", "give",
    "is", "me", "of", "on", "tell", "the", "to", "what", "who",
)

# Words whose presence marks English prose.
ENGLISH_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have",
    "he", "her", "his", "i", "in", "is", "it", "learn", "more", "not", "of", "on",
    "our", "read", "she", "that", "the", "their", "this", "to", "we", "welcome",
    "with", "you", "your",
)

#: Estimated tokens per word where no tokenizer is at hand.
TOKENS_PER_WORD = 1.3
SPACE = r"(?U)\s+"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where a lambda below refers to it.

    Catalyst inlines an outer expression into a lambda, which would compute it
    again for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def normalize(text: Column) -> Column:
    return collapse(F.lower(text))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def words(text: Column) -> Column:
    """White-space separated words; none for a blank text."""
    flat = collapse(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words; a shorter text is one shingle, a blank one none."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        out = F.slice(w, F.lit(1), n - size + 1)
        for k in range(2, size + 1):
            out = F.zip_with(out, F.slice(w, F.lit(k), n - size + 1), lambda a, b: F.concat(a, F.lit(" "), b))
        none = F.array().cast("array<string>")
        return F.when(n == 0, none).when(n < size, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(out))

    return let(words(F.lower(text)), runs)


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """64-bit hashes of the shingles of a text, each once: one pass, and no string is built for a shingle."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        every = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(w))).otherwise(F.array_distinct(every))

    return let(words(F.lower(text)), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def token_count(text: Column) -> Column:
    """Estimated tokens: words * 1.3 rounded down, at least one unless the text is empty."""
    estimate = F.greatest(F.lit(1), F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)).cast("int"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(estimate)


def trim_tokens(text: Column, most: Column | int) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.array_join(F.slice(words(text), F.lit(1), most), " ")


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def alnum_text(text: Column) -> Column:
    return F.array_join(alnum_tokens(text), " ")


def meaningful_terms(text: Column) -> Column:
    """Tokens of over two characters that aren't query stop words, repeats kept."""
    return F.filter(alnum_tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*QUERY_STOPWORDS))


def adjacent_pairs(terms: Column) -> Column:

    def pairs(t: Column) -> Column:
        n = F.size(t)
        both = F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(n < 2, F.array().cast("array<string>")).otherwise(both)

    return let(terms, pairs)


def has_query_phrase(query: Column, content: Column) -> Column:
    """Whether two neighbouring terms of the query stand together in the content."""
    pairs = adjacent_pairs(meaningful_terms(query))
    return let(alnum_text(content), lambda text: F.exists(pairs, lambda p: F.contains(text, p)))


def entity_phrases(query: Column) -> Column:
    """The first two runs of capitalised words; else the first terms, up to four, of at least two."""
    proper = F.regexp_extract_all(query, F.lit(r"\b[A-Z][\w-]*(?:\s+[A-Z][\w-]*)+\b"), F.lit(0))
    terms = meaningful_terms(query)
    other = F.when(F.size(terms) >= 2, F.array(F.array_join(F.slice(terms, 1, 4), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(proper) > 0, F.slice(proper, 1, 2)).otherwise(other)


def query_variants(query: Column) -> Column:
    """The query and three rewordings of each entity phrase, distinct, in order."""
    q = F.trim(query)
    more = F.flatten(
        F.transform(
            entity_phrases(q),
            lambda p: F.array(F.concat(F.lit("Find information about "), p), F.concat(p, F.lit(" profile")), F.concat(p, F.lit(" engineer profile"))),
        )
    )
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(q), more)))


def sentences(text: Column) -> Column:
    """Split after ., ! or ? that white space follows."""
    return F.split(text, r"(?<=[.!?])\s+")


def looks_english(text: Column, least_words: int = 20, least_known: int = 2) -> Column:
    flat = F.lower(collapse(text))
    w = F.regexp_extract_all(flat, F.lit("[a-z']+"), F.lit(0))
    known = F.size(F.filter(w, lambda x: x.isin(*ENGLISH_WORDS)))
    return (F.length(flat) >= 100) & (F.size(w) >= least_words) & ((known >= least_known) | (known / F.greatest(F.size(w), F.lit(1)) >= 0.03))


def preview(text: Column, size: int = 180) -> Column:
    return F.substring(collapse(text), 1, size)


def truncate_for_rerank(text: Column, most_words: int = 256, most_chars: int = 1800) -> Column:
    """White space collapsed, cut by characters first, then by words."""
    cut = F.rtrim(F.substring(collapse(text), 1, most_chars))
    return F.array_join(F.slice(F.split(cut, " "), 1, most_words), " ")


def tidy_markdown(text: Column) -> Column:
    """Unix line ends, no trailing blanks, at most one empty line, one line end at the end."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"[ \t\x0B\f\r]+(?=\n|$)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit("")).otherwise(F.concat(t, F.lit("\n")))


def clean_price(price: Column) -> Column:
    """Digits, dots and commas; a lone comma becomes a dot; the text itself if nothing is left."""
    kept = F.regexp_replace(F.trim(price), r"[^\d.,]", "")
    commas = F.length(kept) - F.length(F.regexp_replace(kept, ",", ""))
    kept = F.when((commas == 1) & ~F.contains(kept, F.lit(".")), F.regexp_replace(kept, ",", ".")).otherwise(kept)
    kept = F.regexp_replace(kept, r"^[.,]+|[.,]+$", "")
    return F.when(kept == "", F.trim(price)).otherwise(kept)


# Availability names by their letters.
AVAILABILITY = {
    "instock": "InStock",
    "outofstock": "OutOfStock",
    "preorder": "PreOrder",
    "discontinued": "Discontinued",
    "limitedavailability": "LimitedAvailability",
    "onlineonly": "OnlineOnly",
    "soldout": "OutOfStock",
}


def simple_availability(value: Column) -> Column:
    key = F.regexp_replace(F.lower(value), "[^a-z]", "")
    known = F.create_map(*[F.lit(x) for kv in AVAILABILITY.items() for x in kv])
    return F.coalesce(F.element_at(known, key), F.trim(value))
