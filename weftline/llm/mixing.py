r"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a budget of words.  Complete epochs come first: a source whose
budget is e times its size, and a remainder, has every document taken e times.
The remainder is drawn without replacement: documents get exponential keys
-ln(u)/w scaled by a quality weight w, are sorted by key within their source,
and are taken while the prefix sum of their sizes stays within the remainder
(the document at the edge is taken if at least half of it fits).

No source is sorted whole.  Its keys are counted in equal intervals, the
intervals are prefix-summed, and the one in which the budget ends is counted
again in finer ones, until it holds at most BUCKET_ROWS rows or a single key;
only these rows are sorted.  How keys are spread (that is, which weights there
are) changes the number of rounds, not the rows that one task sorts.

Defined cases: null text has size 0 and weight 1; null and empty sources are
sources of their own, null last; a source without words has target 0 and
nothing is taken; rows with equal keys are ordered by doc_id (nulls first) and
size; rows that agree in all of these are numbered, and the cut falls between
them; weights must be positive and finite; an empty table gives an empty
result; extra columns pass through ``mix`` untouched: where one has the name of
a column that ``mix`` adds, the added one gets underscores before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, materialize, text_or_empty, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Symbols that stand for layout or noise rather than prose; a document's
#: quality weight falls with their share.
NOISE = "|#$%&*!"
#: No source is taken more often than this.
MOST_EPOCHS = 3
#: Rows of a source that are sorted, at most (equal rows count once).
BUCKET_ROWS = 256
#: Intervals into which the keys of a source are counted at once.
INTERVALS = 1024
#: Weights of the sources in code-point order, repeating.
CYCLE = (1, 2, 3)
#: What ``mix`` adds, in this order.
ADDED = ("size", "source_size", "target", "copies", "taken")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight() -> Column:
    """Between 0.1 and 1: lower, the larger the share of noise symbols."""
    text = text_or_empty()
    noise = F.length(text) - F.length(F.translate(text, NOISE, ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * noise / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column) -> Column:
    """Reproducible u in (0, 1) from the doc_id: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    return -F.log(uniform(doc_id)) / weight


def water_fill(stats: DataFrame, share: float = 1.0) -> DataFrame:
    """Adds ``target``: ``share`` of all words by weight, none above its cap.

    stats: source, source_size.  One row per source, so the window without
    partition sorts a list of sources, not of documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in CYCLE])
    s = stats.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(CYCLE) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    # Filling by weight caps sources in the order of cap / weight; source i is
    # capped if the level, with all before it capped, reaches its own ratio.
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    s = s.withColumn("capped", F.col("cap") <= level * F.col("w"))
    capped = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    open_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything)
    s = s.withColumn(
        "target",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("total") - capped) / open_w * F.col("w")),
    )
    return s.select("source", "source_size", "target")


def _where_it_ends(sums: DataFrame) -> DataFrame:
    """Per source the first interval, of those counted, up to which the words reach the rest.

    sums: source, b, words, n, lo, hi (least and largest key), rest, before.
    """
    run = Window.partitionBy("source").orderBy("b")
    upto = F.col("before") + F.sum("words").over(run)
    ends = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("rest"))
    first = F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("before"), "n", "lo", "hi", "rest"))
    return ends.groupBy("source").agg(first.alias("e")).select("source", *[F.col(f"e.{c}").alias(c) for c in ("before", "n", "lo", "hi", "rest")])


def _counts() -> list[Column]:
    return [F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")]


def _small(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast join, if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _in_edge(sized: DataFrame, edge: DataFrame) -> DataFrame:
    e = edge.select(F.col("source").alias("es"), *[c for c in edge.columns if c != "source"])
    inside = (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))
    return sized.join(_small(e), F.col("source").eqNullSafe(F.col("es")) & inside)


def plan(sized: DataFrame) -> DataFrame:
    """One row per source: source_size, target, epochs, and where its draw ends.

    sized: doc_id, source, size, key.  The draw takes the rows before ``cut`` in
    the order of key, doc_id and size, and ``cut_take`` of the ``cut_of`` rows at it.
    """
    coarse = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * INTERVALS), F.lit(INTERVALS - 1)).cast("int")
    sums = materialize(sized.groupBy("source", coarse.alias("b")).agg(*_counts()), "mix-intervals")
    s = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    s = s.withColumn("epochs", epochs.cast("int"))
    s = materialize(s.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-sources")
    open_ = s.where("rest > 0").select(F.col("source").alias("s2"), "rest")
    first = sums.join(open_, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("before", F.lit(0).cast("long"))
    edge = materialize(_where_it_ends(first), "mix-edge")
    wide = (F.col("n") > BUCKET_ROWS) & (F.col("lo") < F.col("hi"))
    left = edge.where(wide).agg(F.sum("n")).head()[0]
    while left:  # each round leaves one interval of those of the round before
        step = (F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        b = F.least(F.floor(step * INTERVALS), F.lit(INTERVALS - 1)).cast("int")
        rows = _in_edge(sized, edge.where(wide).drop("n")).withColumn("b", b)
        finer = rows.groupBy(F.col("es").alias("source"), "b", "rest", "before").agg(*_counts())
        edge = materialize(_where_it_ends(finer).unionByName(edge.where(~wide)), "mix-edge")
        now = edge.where(wide).agg(F.sum("n")).head()[0]
        if now == left:
            break
        left = now
    # equal rows are one unit of several; a single key has as many units as it has doc_ids and sizes
    units = _in_edge(sized, edge).groupBy("es", "key", "doc_id", "size", "rest", "before").agg(F.count(F.lit(1)).alias("of"))
    run = Window.partitionBy("es").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("rest") - F.col("before") - (F.sum(F.col("size") * F.col("of")).over(run) - F.col("size") * F.col("of"))
    units = units.withColumn("room", room).where((F.col("room") > 0) & (F.col("room") * 2 >= F.col("size")))
    take = F.when(F.col("size") > 0, F.least(F.floor(F.col("room") / F.col("size") - 0.5) + 1, F.col("of"))).otherwise(F.col("of"))
    last = F.max(F.struct(F.struct("key", "doc_id", "size").alias("cut"), take.cast("long").alias("take"), "of"))
    cut = units.groupBy(F.col("es").alias("cs")).agg(last.alias("u"))
    before = edge.select(F.col("source").alias("fs"), F.col("lo").alias("from"))
    out = (
        s.join(before, F.col("source").eqNullSafe(F.col("fs")), "left")
        .join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
        .select("source", "source_size", "target", "epochs", "from", F.col("u.cut").alias("cut"), F.col("u.take").alias("cut_take"), F.col("u.of").alias("cut_of"))
    )
    return materialize(out, "mix-plan")


def _number(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``__i``, their number from 1 among the rows of one ``by``: first by partition, then within it."""
    rows = materialize(rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__at", 33)), "mix-equal")
    run = Window.partitionBy(by).orderBy("__p")
    starts = rows.groupBy(by, "__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.sum("__n").over(run) - F.col("__n"))
    starts = starts.select(F.col(by).alias("__b"), F.col("__p").alias("__q"), "__before")
    within = F.row_number().over(Window.partitionBy(by, "__p").orderBy("__at"))
    rows = rows.withColumn("__i", within).join(starts, (F.col(by) == F.col("__b")) & (F.col("__p") == F.col("__q")))
    return rows.withColumn("__i", F.col("__i") + F.col("__before"))


def _take(rows: DataFrame, p: DataFrame) -> DataFrame:
    """rows: ``r`` (any struct), doc_id, source, size, key.  Returns ``r`` and the columns that mixing adds."""
    p = p.select(*[F.col(c).alias(f"p_{c}") for c in p.columns], F.xxhash64("source").alias("p_id"))
    d = rows.join(_small(p), F.col("source").eqNullSafe(F.col("p_source")))
    mine = F.struct("key", "doc_id", "size")
    # before the interval in which the budget ends every row is drawn, whether or not a row of it is
    before = F.coalesce((F.col("key") < F.col("p_from")) | (mine < F.col("p_cut")), F.lit(False))
    at = F.coalesce(mine == F.col("p_cut"), F.lit(False)) & (F.col("p_cut_take") > 0)
    parted = at & (F.col("p_cut_take") < F.col("p_cut_of"))
    own = lambda x, drawn: x.select("r", *_added(drawn))
    out = own(d.where(~parted), before | at)
    if p.where("p_cut_take > 0 AND p_cut_take < p_cut_of").head() is not None:
        equal = _number(d.where(parted), "p_id")
        out = out.unionByName(own(equal, F.col("__i") <= F.col("p_cut_take")))
    return out


def _added(drawn: Column) -> list[Column]:
    copies = F.col("p_epochs") + F.when(drawn, 1).otherwise(0)
    values = (F.col("size"), F.col("p_source_size"), F.col("p_target"), copies.cast("int"), (copies * F.col("size")).cast("long"))
    return [v.alias(c) for v, c in zip(values, ADDED, strict=True)]


def _sized(docs: DataFrame, weight: Column | None) -> DataFrame:
    weight = quality_weight() if weight is None else weight
    return docs.select("doc_id", "source", n_words(text_or_empty()).alias("size"), sampling_key(F.col("doc_id"), weight).alias("key"))


def mix(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken after its own columns."""
    p = plan(materialize(_sized(docs, weight), "mix-sized"))
    weight = quality_weight() if weight is None else weight
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")
    rows = docs.select(own, "doc_id", "source", n_words(text_or_empty()).alias("size"), sampling_key(F.col("doc_id"), weight).alias("key"))
    names = unused(docs.columns, *ADDED)
    return _take(rows, p).select(*[F.col("r")[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(ADDED, names, strict=True)])


def mix_report(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; texts are read once."""
    sized = materialize(_sized(docs, weight), "mix-sized")
    rows = sized.select(F.struct("doc_id", "source").alias("r"), "doc_id", "source", "size", "key")
    return _take(rows, plan(sized)).select("r.doc_id", "r.source", *ADDED)


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken.  ``columns`` are those of the documents, which come first in ``mixed``."""
    copies = mixed.columns[len(columns) + ADDED.index("copies")]
    own = [F.col(f"`{c}`") for c in columns]
    (each,) = unused(mixed.columns, "n")
    return mixed.where(F.col(copies) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*own)
