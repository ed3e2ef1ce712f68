"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of shuffled documents that is served in proportion to its target. A document copy starts at virtual time
(words of its source before it) / target and finishes at (words up to its end) / target. All copies form one stream in the order of
their finish times, and the stream is cut where the total budget of words is spent. Since the targets add up to the budget, that
is virtual time 1: copies that finish by then are taken whole, and the copy that each source is serving at that moment gives the
words it has delivered so far, so a source's words differ from its target by less than one.

No task holds a source: the place of a document in its queue is the sum of whole *cells* (leading digits of its shuffle key,
combined before they are shuffled) and of the rows before it in its own cell. The stream is put in order the same way, by ranges
of finish time.

Defined results: a NULL text has no words; a document without words is never taken; NULL is a source of its own, after all others;
NULL ids are shuffled by their text; repeated rows are separate documents; an empty table gives an empty mix. Columns of the input
that are not named are ignored, whatever their names, unless listed in ``keep``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanledger.staging import staged

from .words import n_words

#: Ranges of virtual time in which the stream is ordered, per unit of time.
RANGES = 4096
#: Ranges of virtual time to which ``mix`` sends the copies of whole cells.
MIX_RANGES = 256
#: Hex digits of the shuffle key that name a cell.
CELL_DIGITS = 3
#: Sources whose cells ``mix`` sends to all tasks: 16 bytes for each of 4096 cells, 34 MB for so many sources.
MAP_SOURCES = 512


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """``target`` words of every source in (source_key, source, source_size).

    Sources in code point order, NULL last, take the weights in turn and share ``budget`` times all words. No source gives more
    than ``most`` times its words; what it cannot give is shared by weight among the others. One row per source, so the
    table may be ordered in one task.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("_place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("*", weight.alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_most"),
                           (F.sum("source_size").over(everything) * F.lit(float(budget))).alias("_budget"))
    # Sources fill up in the order of most / weight. Before the first that does not, all are full.
    filling = W.orderBy(F.col("_most") / F.col("_weight"), "_place")
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = ranked.select("*", F.row_number().over(filling).alias("_turn"),
                           (F.col("_budget") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))).alias("_rest"),
                           F.sum("_weight").over(after).alias("_share"))
    stays = F.col("_most") * F.col("_share") > F.col("_weight") * F.col("_rest")
    first = F.min(F.when(stays, F.struct("_turn", "_rest", "_share"))).over(everything)
    ranked = ranked.withColumn("_first", first)
    level = F.col("_weight") * F.col("_first._rest") / F.col("_first._share")
    return ranked.select("source_key", "source_size", F.when(F.col("_turn") >= F.col("_first._turn"), level)
                         .otherwise(F.col("_most")).alias("target"))


def schedule(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: int = 2, seed: str = "mix",
             keep: Sequence[str] = (), stage: bool = False) -> DataFrame:
    """The document copies in their queues.

    Per document and pass (0 to ``most`` - 1): ``cell`` and ``no`` (together with source_key the identity of the row), doc_id,
    source, size, source_size, target, ``first_word`` (words of the source before this copy), ``finish`` (virtual) and
    ``words`` (taken from this copy). ``keep`` names columns carried along in the struct ``kept``. With ``stage`` the rows, their
    words counted, are written to the shared folder first, so that the texts are read once and not for every total.
    """
    rows, cells, _ = _parts(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, budget=budget, most=most, seed=seed,
                            keep=keep, stage=stage)
    return _queues(rows, cells, most)


def _parts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2),
           budget: float = 1.5, most: int = 2, seed: str = "mix", keep: Sequence[str] = (), stage: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """(documents with size, shuffle key and cell; cells with the words before and up to their end, source_size and target; most)."""
    text, doc_id, source = F.col(text_col), F.col(id_col), F.col(source_col)
    name = F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
                       n_words(text).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), name)).alias("_key"),
                       F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("kept"))
    rows = rows.withColumn("cell", F.substring("_key", 1, CELL_DIGITS))
    rows = staged(rows) if stage else rows
    cells = rows.groupBy("source_key", "cell").agg(F.first("source").alias("source"), F.sum("size").alias("_cell_size"))
    in_source = W.partitionBy("source_key")
    earlier = in_source.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("*", F.coalesce(F.sum("_cell_size").over(earlier), F.lit(0)).alias("_before")).withColumn("_after", F.col("_before") + F.col("_cell_size"))
    sizes = cells.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("_cell_size").alias("source_size"))
    return rows, cells.drop("source").join(source_targets(sizes, weights, budget, most), "source_key"), most


def _queues(rows: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    in_cell = W.partitionBy("source_key", "cell").orderBy("_key", "doc_id", "size")
    queue = rows.join(cells, ["source_key", "cell"]).select(
        "source_key", "cell", F.row_number().over(in_cell).alias("no"), "doc_id", "source", "size", "source_size", "target", "kept",
        (F.col("_before") + F.sum("size").over(in_cell.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")).alias("_start"))
    copies = queue.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"))
    first_word = F.col("_start") + F.col("pass") * F.col("source_size")
    return copies.select("source_key", "cell", "no", "doc_id", "source", "size", "source_size", "target", "kept", "pass",
                         first_word.alias("first_word"),
                         ((first_word + F.col("size")) / F.when(F.col("target") > 0, F.col("target"))).alias("finish"),
                         served(first_word, F.col("size"), F.col("target")).alias("words"))


def served(first_word: Column, size: Column, target: Column) -> Column:
    """Words of a copy that its queue has delivered when the budget is spent."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(size, F.floor(target).cast("bigint") - first_word))


def stream(copies: DataFrame) -> DataFrame:
    """The taken copies as one stream: adds ``ahead``, the words of all copies that finish earlier.

    A range sort in which the ranges of finish time are fixed and even: range totals are combined before the shuffle, and rows are
    sorted within their range only.
    """
    taken = copies.filter(F.col("words") > 0).withColumn("_range", F.floor(F.least(F.col("finish"), F.lit(1.0)) * RANGES))
    ranges = taken.groupBy("_range").agg(F.sum("words").alias("_words"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy("_range").orderBy("finish", "source_key", "cell", "no", "pass")
    return taken.join(ranges, "_range").withColumn(
        "ahead", F.col("_ahead") + F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")
    ).drop("_range", "_ahead")


def mixed_documents(copies: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, ``taken`` (words over all passes) and ``at`` (words of the stream
    ahead of its first copy, NULL where nothing of it is taken)."""
    rest = copies.filter(F.col("words") == 0).withColumn("ahead", F.lit(None).cast("bigint"))
    return stream(copies).unionByName(rest).groupBy("source_key", "cell", "no").agg(
        F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"),
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"),
        F.min("ahead").alias("at")).drop("source_key", "cell", "no")


def mix(docs: DataFrame, *, keep: Sequence[str], map_sources: int = MAP_SOURCES, **options) -> DataFrame:
    """The mixed corpus: one row per taken copy with the columns in ``keep``, ``copy`` (from 1), ``words`` to use of it (less than its
    words only for the copy in service when the budget ends) and ``finish``, sorted by finish time over all partitions.

    The kept columns hold the texts, so they travel once. All copies of a cell in one pass finish within a stretch of virtual time that is known
    from the totals of the cells. Where that stretch lies in one of ``MIX_RANGES`` ranges, the copies go there straight away, and their order in the cell
    is found there; only copies of cells that cross the end of a range are put in order first (some 4 % of a large source).

    The totals reach the documents as one row per source, which is broadcast and as large for any number of documents. Of more than ``map_sources``
    sources they are joined instead: the texts travel twice, once to their cells and once in the order of the mix.
    """
    rows, cells, most = _parts(docs, keep=keep, **options)
    cells = staged(cells)
    if cells.select("source_key").distinct().count() > map_sources:
        order = ["finish", "source_key", "cell", "no", "pass"]
        taken = _queues(rows, cells, most).filter("words > 0").repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        taken = _taken_by_range(rows, staged(_cells_by_source(cells)), most)
    return taken.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], (F.col("pass") + 1).alias("copy"), "words", "finish")


def _cells_by_source(cells: DataFrame) -> DataFrame:
    """One row per source: source_key, source_size, target, and ``_befores`` and ``_afters``, the totals of all its cells by number."""
    number = F.conv("cell", 16, 10).cast("int")
    every = cells.select("source_key", "source_size", "target").distinct().withColumn("_no", F.explode(F.sequence(F.lit(0), F.lit(16**CELL_DIGITS - 1))))
    placed = every.join(cells.select("source_key", number.alias("_no"), "_before", "_after"), ["source_key", "_no"], "left")
    in_order = F.array_sort(F.collect_list(F.struct("_no", "_before", "_after")))
    by_source = placed.groupBy("source_key", "source_size", "target").agg(in_order.alias("_in_order"))
    return by_source.select("source_key", "source_size", "target", *[F.col(f"_in_order.{c}").alias(f"{c}s") for c in ("_before", "_after")])


def _taken_by_range(rows: DataFrame, by_source: DataFrame, most: int) -> DataFrame:
    """The taken copies in the order of the mix; the totals of the cells go to the documents."""
    at = F.conv("cell", 16, 10).cast("int") + 1
    placed = rows.join(F.broadcast(by_source), "source_key").select(
        "source_key", "cell", "_key", "doc_id", "size", "source_size", "target", "kept", *[F.element_at(f"{c}s", at).alias(c) for c in ("_before", "_after")])
    ends = [(F.col(c) + F.col("pass") * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target")) for c in ("_before", "_after")]
    copies = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).filter(
        _first_word(F.col("_before")) < F.floor("target")).withColumns({"_range": _mix_range(ends[0]), "_last": _mix_range(ends[1])})
    columns = ["source_key", "cell", "_key", "doc_id", "size", "source_size", "target", "kept", "_before", "pass"]
    whole = copies.filter("_range = _last").select(*columns, "_range", F.lit(None).cast("bigint").alias("_known"))
    cut = _in_cells(copies.filter("_range < _last").select(*columns))
    cut = cut.select(*columns, _mix_range(_finish(F.col("_start"))).alias("_range"), F.col("_start").alias("_known"))
    placed = _in_cells(whole.unionByName(cut).repartitionByRange("_range"), ["_range"])
    start = F.coalesce("_known", "_start")
    taken = placed.select("*", served(_first_word(start), F.col("size"), F.col("target")).alias("words"), _finish(start).alias("finish")).filter("words > 0")
    return taken.sortWithinPartitions("finish", "source_key", "cell", "_key", "doc_id", "size", "pass")


def _mix_range(time: Column) -> Column:
    return F.floor(F.least(time, F.lit(1.0)) * MIX_RANGES)


def _first_word(start: Column) -> Column:
    return start + F.col("pass") * F.col("source_size")


def _finish(start: Column) -> Column:
    return (_first_word(start) + F.col("size")) / F.when(F.col("target") > 0, F.col("target"))


def _in_cells(copies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``_start``: words of the source before the copy's document. Right where all copies of a cell and pass have the same keys."""
    in_cell = W.partitionBy(*keys, "source_key", "cell", "pass").orderBy("_key", "doc_id", "size")
    return copies.withColumn("_start", F.col("_before") + F.sum("size").over(in_cell.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
