"""Guard rails for free text as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of instructions that are turned down, in order, with the reason.
BLOCKED = (
    (r"ignore\s+(all\s+)?(previous|above|prior|system)\s+(instructions?|prompt)", "injection: ignore previous"),
    (r"disregard\s+(all\s+)?(previous|above|prior|system|your)\s+", "injection: disregard"),
    (r"forget\s+(all\s+)?(previous|above|prior|your)\s+", "injection: forget"),
    (r"override\s+(your\s+)?(system\s+)?(prompt|instructions?)", "injection: override system prompt"),
    (r"\bmake\s+up\s+facts?\b", "hallucination: make up facts"),
    (r"\binvent\s+facts?\b", "hallucination: invent facts"),
    (r"\bfabricate\b", "hallucination: fabricate"),
    (r"\bhallucinate\b", "hallucination: hallucinate"),
    (r"\bdo\s+not\s+cite\b", "citation suppression"),
    (r"\bno\s+citations?\b", "citation suppression"),
    (r"\bwithout\s+(any\s+)?sources?\b", "citation suppression"),
    (r"reveal\s+(your\s+)?(system\s+)?prompt", "exfiltration: reveal prompt"),
    (r"repeat\s+(your\s+)?(system\s+)?prompt", "exfiltration: repeat prompt"),
    (r"print\s+(your\s+)?(system\s+)?prompt", "exfiltration: print prompt"),
    (r"you\s+are\s+now\s+(?!a\s+retrieval)", "role hijack: you are now"),
    (r"act\s+as\s+(?!a\s+retrieval)", "role hijack: act as"),
    (r"pretend\s+(to\s+be|you\s+are)", "role hijack: pretend"),
    (r"no\s+matter\s+what\s+(the\s+)?(context|question|input|user)", "context bypass: no matter what"),
    (r"regardless\s+of\s+(the\s+)?(context|question|input|user)", "context bypass: regardless of"),
    (r"ignore\s+(all\s+)?(constraints|rules|instructions?|guidelines)", "context bypass: ignore constraints"),
    (r"always\s+(respond|reply|say|answer)\s+(with\s+)?\S+\s+(no\s+matter|regardless)", "fixed-output override"),
    (r"\b(always|only)\s+(respond|reply|say|answer)\b.{0,80}\b(no\s+matter\s+what|regardless\s+of\b)", "fixed-output override"),
    (r"\b(respond|reply|say|answer)\s+(as|with)\b.{0,80}\b(no\s+matter\s+what|regardless\s+of\b)", "fixed-output override"),
    (r"\banswer\s+only\s+['\"]?\w+['\"]?\s+(no\s+matter|regardless|always)", "fixed-output override"),
    (r"ignore\s+(the\s+)?(context|question|user\s+input)", "context bypass: ignore context"),
    (r"\b(be|use|respond\s+with|write\s+in|speak\s+in|answer\s+in)\s+(a\s+)?(rude|offensive|aggressive|vulgar|profane|abusive|hateful|racist|sexist|filthy)\b", "inappropriate tone directive"),
    (r"\bfilthy\s+(language|tone|style)\b", "inappropriate tone directive"),
    (r"\binsult\s+(the\s+)?(user|person|questioner|human)\b", "abusive directive: insult user"),
    (r"\b(threaten|harass|bully|demean|degrade|humiliate)\s+(the\s+)?(user|person|questioner)\b", "abusive directive"),
    (r"\buse\s+(swear\s+words?|curse\s+words?|profanity)\b", "profanity directive"),
    (r"\bswear\s+at\b", "profanity directive"),
)
# Whole texts that pass although a pattern matches them.
ALLOWED = (
    r"do\s+not\s+invent\s+facts?\.?",
    r"never\s+invent\s+facts?\s+not\s+supported\s+by\s+retrieved\s+information\.?",
    r"never\s+invent\s+facts?\s+not\s+supported\s+by\s+website\s+knowledge\.?",
)
# Profane words, and the letters that symbols stand for.
PROFANE = (
    "fuck", "fck", "fuk", "fvck", "fuc", "shit", "sht", "shyt", "ass", "arse", "arsehole", "asshole",
    "bitch", "btch", "biatch", "bastard", "bstard", "bullshit", "bs", "cunt", "cnt", "cock", "cok", "crap",
    "damn", "dick", "dck", "piss", "pussy", "wanker", "wank", "nigger", "nigga", "faggot", "fag", "retard",
    "whore", "slut", "twat",
)
PROFANE_PHRASES = ("piss off",)
SYMBOLS, LETTERS = "@01345!$+78|", "aoieasisttbi"
# Fragments of constraints that contradict grounding.
CONTRADICTIONS = (
    "invent", "fabricate", "make up", "don't cite", "do not cite", "no citations", "without sources", "ignore context",
    "ignore the context", "no matter what", "regardless of the", "always answer", "answer as", "respond as", "reply as", "say as",
)


def allowed(text: Column) -> Column:
    t = F.trim(text)
    out = F.lit(False)
    for p in ALLOWED:
        out = out | t.rlike(rf"(?i)\A(?:{p})\z")
    return out


def profane(text: Column) -> Column:
    """Whether a word, with symbols read as letters and filling removed, is profane."""
    t = F.regexp_replace(F.translate(F.lower(text), SYMBOLS, LETTERS), r"[*#_\-]+", "")
    found = F.arrays_overlap(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), F.array(*[F.lit(w) for w in PROFANE]))
    for p in PROFANE_PHRASES:
        found = found | F.contains(t, F.lit(p))
    return found


def violation(text: Column) -> Column:
    """The reason why a text is turned down, or null."""
    out = F.when(allowed(text), F.lit(None).cast("string"))
    for pattern, reason in BLOCKED:
        out = out.when(text.rlike(f"(?i){pattern}"), reason)
    return out.when(profane(text), "inappropriate language")


def sanitize(constraints: Column) -> Column:
    """Constraints without those that contradict grounding."""

    def fine(c: Column) -> Column:
        bad = F.lit(False)
        for f in CONTRADICTIONS:
            bad = bad | F.contains(F.lower(c), F.lit(f))
        return allowed(c) | ~bad

    return F.filter(constraints, fine)
