"""Vector distance, reranking and confidence scores as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import adjacent_pairs, alnum_tokens, let, meaningful_terms

# Phrases of answers that say nothing.
EMPTY_ANSWERS = (
    "i don't know",
    "i do not know",
    "not enough information",
    "insufficient information",
    "cannot determine",
    "can't determine",
    "based on the provided context",
    "no relevant context",
    "not present in the context",
    "cannot answer",
)
# The same for the choice of the response mode.
FALLBACK_ANSWERS = (
    "i don't know",
    "i do not know",
    "not enough information",
    "insufficient information",
    "cannot determine",
    "can't determine",
    "no relevant context",
    "not present in the context",
    "cannot answer",
    "couldn't find a clear answer",
    "can help with the related information that is available",
    "can share the related information that is available",
)


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return F.when(distance.isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + distance))


def retrieval_confidence(distance: Column) -> Column:
    """Aggregate over one query's hits; hits without distance don't count."""
    s = F.when(distance.isNotNull(), similarity(distance))
    return clamp(F.coalesce(F.lit(0.75) * F.max(s) + F.lit(0.25) * F.avg(s), F.lit(0.0)))


def margin_confidence(scores: Column) -> Column:
    """Of the array of one query's scores: sigmoid of the lead of the best; 0 without any."""
    s = F.sort_array(scores, asc=False)
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(
        sigmoid(F.element_at(s, 1) - F.when(F.size(s) > 1, F.try_element_at(s, F.lit(2))).otherwise(F.lit(0.0)))
    )


def pair_score(query_terms: Column, text_terms: Column, text_set: Column | None = None, blob: Column | None = None, pairs: Column | None = None) -> Column:
    """Share of the query's terms found, share of the text's terms that are the query's, and a bonus for a phrase."""
    q = F.array_distinct(query_terms)
    t = F.array_distinct(text_terms) if text_set is None else text_set
    text = F.array_join(text_terms, " ") if blob is None else blob
    shared = F.size(F.array_intersect(q, t))
    pairs = adjacent_pairs(query_terms) if pairs is None else pairs
    found = F.exists(pairs, lambda p: F.contains(blob, p)) if blob is not None else let(text, lambda t: F.exists(pairs, lambda p: F.contains(t, p)))
    bonus = F.when(found, F.lit(1.0)).otherwise(F.lit(0.0))
    score = F.lit(0.7) * (shared / F.size(q)) + F.lit(0.25) * (shared / F.size(t)) + F.lit(0.05) * bonus
    return F.when(shared == 0, F.lit(0.0)).otherwise(clamp(score))


def pair_score_of_texts(query: Column, text: Column) -> Column:
    return pair_score(meaningful_terms(query), meaningful_terms(text))


def grounding(answer: Column, context: Column) -> Column:
    """Share of the answer's tokens that the context has."""
    a, c = alnum_tokens(answer), F.array_distinct(alnum_tokens(context))
    found = let(c, lambda known: F.size(F.filter(a, lambda t: F.array_contains(known, t))))
    return F.when((F.size(a) == 0) | (F.size(c) == 0), F.lit(0.0)).otherwise(found / F.size(a))


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def answer_quality(answer: Column, context: Column, grounded: Column) -> Column:
    """One minus penalties for short, empty, unsupported or evasive answers."""
    a = F.trim(answer)
    low, ctx = F.lower(a), F.lower(F.coalesce(context, F.lit("")))
    n = F.size(alnum_tokens(a))
    numbers = F.regexp_extract_all(low, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    unsupported = let(ctx, lambda known: F.size(F.filter(numbers, lambda x: ~F.contains(known, x))))
    z = F.lit(0.0)
    score = (
        F.lit(1.0)
        - F.when(n < 4, F.lit(0.35)).when(n < 8, F.lit(0.15)).otherwise(z)
        - F.when(any_phrase(low, EMPTY_ANSWERS), F.lit(0.45)).otherwise(z)
        - F.least(F.lit(0.4), F.lit(0.15) * unsupported)
        - F.when(grounded < 0.2, F.lit(0.3)).when(grounded < 0.5, F.lit(0.15)).otherwise(z)
        - F.when(F.contains(low, F.lit("i don't know")) | F.contains(low, F.lit("not enough information")), F.lit(0.15)).otherwise(z)
    )
    return F.when(a == "", z).otherwise(clamp(score))


def final_confidence(retrieval: Column, rerank: Column, grounded: Column, quality: Column) -> Column:
    return clamp(F.lit(0.35) * clamp(retrieval) + F.lit(0.30) * clamp(rerank) + F.lit(0.20) * clamp(grounded) + F.lit(0.15) * clamp(quality))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.65, "medium").otherwise("low")


def initial_mode(retrieval: Column, rerank: Column, context: Column, strict: bool = True, infer: bool = True) -> Column:
    blended = F.lit(0.6) * retrieval + F.lit(0.4) * rerank
    out = F.when(F.trim(context) == "", "fallback")
    if strict:
        out = out.when(blended >= 0.78, "complete")
    return out.when(blended >= 0.58, "partial").otherwise("guided" if infer else "partial")


def answer_mode(answer: Column, context: Column, confidence: Column, infer: bool = True) -> Column:
    low = F.lower(F.trim(answer))
    return (
        F.when((low == "") | (F.trim(context) == "") | any_phrase(low, FALLBACK_ANSWERS), "fallback")
        .when(confidence >= 0.82, "complete")
        .when(confidence >= 0.65, "partial")
        .otherwise("guided" if infer else "partial")
    )


def needs_recovery(answer: Column, confidence: Column, context: Column) -> Column:
    low = F.lower(F.trim(answer))
    return (low == "") | any_phrase(low, FALLBACK_ANSWERS) | ((confidence < 0.5) & (F.trim(context) != ""))
