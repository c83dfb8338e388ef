"""Queries that build prompts and choose between answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..operators import settings as S
from ..storage import table
from .settings_queries import _prompts


def _asked(spark, sf):
    """Questions with a context, a mode and settings that cover all branches."""
    b = S.normalize_prompt(_prompts(spark, sf), P.ROLE, list(P.CONSTRAINTS)).join(table(spark, sf, "benchmark"), "item_id")
    i = F.col("item_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    return b.select(
        "item_id", "text", F.when(i % 5 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit("  Fact "), i.cast("string"), F.lit("\n"))).alias("context"),
        pick("complete", "partial", "guided", "fallback").alias("mode"),
        P.Settings(F.col("role"), pick("calm", P.TONE), F.lit(P.STYLE), pick("helpful", "", "Brief and kind"), F.col("constraints"), i % 3 != 1, i % 2 == 0, i % 7 < 3).columns(),
    )


def prompt_answer(spark, sf):
    a = _asked(spark, sf)
    p = P.answer_prompt(F.col("text"), F.col("context"), F.col("mode"), P.Settings.of("settings"))
    return a.select("item_id", p.alias("p")).select("item_id", F.md5("p").alias("prompt_md5"), F.length("p").cast("long").alias("size"))


def prompt_recovery(spark, sf):
    a = _asked(spark, sf)
    p = P.recovery_prompt(F.col("text"), F.col("context"), F.col("mode"), P.Settings.of("settings"))
    return a.select("item_id", p.alias("p")).select("item_id", F.md5("p").alias("prompt_md5"), F.length("p").cast("long").alias("size"))


def prompt_fallback(spark, sf):
    return _asked(spark, sf).select("item_id", P.fallback_answer(P.Settings.of("settings")).alias("answer"))


def better_answers(spark, sf):
    """Each assistant turn against the next one of its conversation; every ninth is evasive."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    text = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.concat(F.lit("I cannot answer that. "), "text")).otherwise(F.col("text"))
    c = c.select("conv_id", "turn", text.alias("a"))
    c = c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", P.is_evasive(F.col("a")).alias("evasive"), F.md5(P.better_answer(F.col("a"), F.col("b"))).alias("answer_md5"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _array(lines) -> str:
    return "[" + ", ".join(map(_q, lines)) + "]"


_LISTED = "array_to_string(list_transform(list_filter({0}, lambda x: x IS NOT NULL), lambda x: '- ' || x), chr(10))"
_OWN_ROLE = f"CASE WHEN item_id % 4 = 0 THEN {_q(P.ROLE)} ELSE 'Role ' || item_id END"
_A = f"""WITH a AS (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question, CASE WHEN item_id % 5 = 0 THEN {_q(P.NO_CONTEXT)} ELSE 'Fact ' || item_id END AS context,
  ['complete', 'partial', 'guided', 'fallback'][item_id % 4 + 1] AS mode, {_OWN_ROLE} AS role, ['calm', 'friendly'][item_id % 2 + 1] AS tone, ['helpful', '', 'Brief and kind'][item_id % 3 + 1] AS fallback,
  CASE item_id % 3 WHEN 0 THEN {_array(P.CONSTRAINTS)} WHEN 1 THEN {_array([P.MANDATORY, "Be kind"])} ELSE {_array([P.MANDATORY, "Short"])} END AS constraints,
  item_id % 3 <> 1 AS strict, item_id % 2 = 0 AS infer, item_id % 7 < 3 AS identity FROM benchmark)"""
_TAG = "'<{0}>' || chr(10) || {1} || chr(10) || '</{0}>' || chr(10) || chr(10)"


def _sql(parts: dict[str, str]) -> str:
    body = " || ".join(_TAG.format(tag, value) for tag, value in parts.items())
    return f"{_A} SELECT item_id, md5(p) AS prompt_md5, length(p)::BIGINT AS size FROM (SELECT item_id, {body} || 'Answer:' AS p FROM a)"


_HEAD = {"role": "role", "tone": "tone", "style": _q(P.STYLE), "fallback_behavior": "fallback"}
_MIDDLE = {"response_mode": "mode", "context": "context", "question": "question"}
_MODE = "CASE mode " + " ".join(f"WHEN '{m}' THEN {_q(t)}" for m, t in P.BY_MODE.items()) + " END"
_RULES = (
    f"list_concat({_array(P.ALWAYS)}, [{_MODE}, CASE WHEN infer THEN {_q(P.INFER)} END, CASE WHEN strict THEN {_q(P.GROUND)} END, "
    f"CASE WHEN fallback <> '' THEN 'Fallback behavior: ' || fallback || '.' END, CASE WHEN identity THEN {_q(P.AS_US)} ELSE {_q(P.AS_BRAND)} END])"
)
_TRY = f"list_concat({_array(P.RECOVERY)}, [CASE WHEN infer THEN {_q(P.RECOVERY_INFER)} END, CASE WHEN identity THEN {_q(P.RECOVERY_US)} END])"
_VOICE = f"CASE WHEN identity THEN {_q(P.VOICE_US)} ELSE {_q(P.VOICE_BRAND)} END"
_SAID = " ".join(
    f"WHEN {'' if brief else 'NOT '}(lower(fallback) LIKE '%brief%' OR lower(fallback) LIKE '%concise%') AND {'' if us else 'NOT '}identity THEN "
    + _q((P.NOTHING_FOUND_BRIEF if brief else P.NOTHING_FOUND).replace("I c", "We c" if us else "I c", 1).replace("but I", "but we" if us else "but I"))
    for brief in (0, 1)
    for us in (0, 1)
)
_EVASIVE = "({0} = '' OR " + " OR ".join(f"contains(lower({{0}}), {_q(e)})" for e in P.EVASIONS) + ")"

QUERIES = {
    "prompt_answer": (
        prompt_answer,
        _sql(_HEAD | {"voice": _VOICE} | _MIDDLE | {"constraints": _LISTED.format("constraints"), "instructions": _LISTED.format(_RULES)}),
    ),
    "prompt_recovery": (prompt_recovery, _sql(_HEAD | _MIDDLE | {"recovery_instructions": _LISTED.format(_TRY)})),
    "prompt_fallback": (prompt_fallback, f"{_A} SELECT item_id, CASE {_SAID} END AS answer FROM a"),
    "better_answers": (
        better_answers,
        f"""WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'I cannot answer that. ' || text ELSE text END AS a FROM conversations WHERE role = 'assistant'),
        n AS (SELECT *, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c),
        t AS (SELECT *, regexp_replace(coalesce(a, ''), '^\\s+|\\s+$', '', 'g') AS x, regexp_replace(coalesce(b, ''), '^\\s+|\\s+$', '', 'g') AS y FROM n)
        SELECT conv_id, turn, {_EVASIVE.format("x")} AS evasive, md5(CASE WHEN y <> '' AND (x = '' OR ({_EVASIVE.format("x")} AND NOT {_EVASIVE.format("y")}) OR length(y) > length(x)) THEN b ELSE a END) AS answer_md5 FROM t""",
    ),
}
