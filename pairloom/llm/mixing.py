"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's documents share one expected number of copies, target / size of the source. Its whole part is granted, its
fraction is rounded dependently: two open documents move words of expectation between each other, in a direction drawn
so that both expectations stay, until one of them is whole; the other goes on. The words expected of a source are thus
the same after every step, and the words taken differ from the target by less than one document's.

The steps run in a reduction tree: hashing deals a source's documents into blocks, each block ends with one open
document, and these residuals meet in blocks of the next level, up to one block a source. A hot source has more blocks,
not larger ones. Draws are hashes of the rows' values, so reruns and retried tasks agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, free_name, repeated, staged

#: A word is a run of anything but a blank and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """One row a source: ``source, source_size, rows, target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``ceiling`` times its source's size; the excess goes to the others by weight until none is above. In one pass:
    sources fill up in the order of ceiling / weight, and the first that the level found so far doesn't fill sets it.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by = by.withColumn("full", F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
    by = by.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("place", F.row_number().over(filling)).withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))).over(every)
    share = F.coalesce(first["level"] * F.col("weight"), F.col("most"))
    return by.select("source", "source_size", "rows", F.least("most", share).cast("double").alias("target"))


def _step(state: Column, x: Column, seed: int) -> Column:
    """Lets the open document of ``state`` meet the document ``x``; one of the two is whole afterwards."""
    i = state["open"]
    a, p, b, q = i["size"].cast("double"), i["part"], x["size"].cast("double"), x["part"]
    draw = F.pmod(F.xxhash64(i["mark"], x["mark"], F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    gain, loss = F.least(a * (1.0 - p), b * q), F.least(a * p, b * (1.0 - q))
    met = F.struct((draw * (gain + loss) <= loss).alias("up"), a.alias("a"), p.alias("p"), b.alias("b"), q.alias("q"))

    def settle(m: Column) -> Column:
        up, a, p, b, q = m["up"], m["a"], m["p"], m["b"], m["q"]
        first = F.when(up, a * (1.0 - p) <= b * q).otherwise(a * p <= b * (1.0 - q))
        left = (
            F.when(up & first, q - a * (1.0 - p) / b).when(up, p + b * q / a).when(first, q + a * p / b).otherwise(p - b * (1.0 - q) / a)
        )
        goes, stays = F.when(first, i).otherwise(x), F.when(first, x).otherwise(i)
        whole = goes.withField("up", (up == first).cast("int")).dropFields("part")
        rest = stays.withField("part", F.least(F.lit(1.0), F.greatest(F.lit(0.0), left)))
        return F.struct(rest.alias("open"), F.concat(state["done"], F.array(whole)).alias("done"))

    began = F.struct(x.alias("open"), state["done"].alias("done"))
    return F.when(i.isNull(), began).otherwise(F.transform(F.array(met), settle)[0])


def copies(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: int = 3, block: int = 128, seed: int = 42) -> DataFrame:
    """``doc_id, source, size, text_hash, source_size, target, n, total``: the ``n`` rows equal in the first four get
    ``total`` copies together.

    Equal rows are counted before any shuffle and rounded as one, so a repeated row is no hot key. Rows without words
    get the whole part of their copies only. An empty table gives an empty plan.
    """
    per_source = staged(targets(sized, weights, ceiling), "mix-targets")
    most = per_source.agg(F.max("rows")).first()[0] or 0
    rows = sized.groupBy(*UNIT).agg(F.count("*").alias("n"))
    few = per_source.count() <= 50_000  # then the table is below some MB and may be broadcast
    rows = rows.join(F.broadcast(per_source) if few else per_source, rows["source"].eqNullSafe(per_source["source"])).drop(per_source["source"])
    expected = F.col("n") * F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    rows = rows.withColumn("expected", F.least(expected, F.col("n") * F.lit(float(ceiling)))).withColumn("whole", F.floor("expected").cast("long"))
    rows = rows.withColumn("part", F.when(F.col("size") > 0, F.col("expected") - F.col("whole")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("mark", F.xxhash64(*UNIT, F.lit(seed)))
    rows = rows.withColumn("block", F.pmod("mark", F.ceil(F.col("rows") / F.lit(block)).cast("long")))
    source = ["source", "source_size", "target"]
    item = ["size", "mark", "doc_id", "text_hash", "n", "whole", "part"]
    kept = ["size", "doc_id", "text_hash", "n"]
    rows = staged(rows.select(*source, *item, "block"), "mix-rows")
    drop_staged(per_source)
    ready = [rows.filter(F.col("part") <= 0).select(*source, *kept, F.col("whole").alias("total"))]
    level, blocks = rows.filter(F.col("part") > 0), max(1, -(-most // block))
    while True:
        listed = level.groupBy(*source, "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), *item))).alias("met"))
        kind = level.select(F.struct(F.lit(0).cast("long").alias("order"), *item).alias("x")).schema["x"].dataType
        done = F.transform(F.expr("slice(met, 1, 0)"), lambda x: x.withField("up", F.lit(0)).dropFields("part"))
        start = F.struct(F.lit(None).cast(kind).alias("open"), done.alias("done"))
        met = staged(listed.select(*source, "block", F.aggregate("met", start, lambda s, x: _step(s, x, seed)).alias("s")), "mix-level")
        settled = met.select(*source, F.explode("s.done").alias("d"))
        ready.append(settled.select(*source, *[f"d.{c}" for c in kept], (F.col("d.whole") + F.col("d.up")).alias("total")))
        level = met.select(*source, *[F.col(f"s.open.{c}").alias(c) for c in item], F.floor(F.col("block") / block).cast("long").alias("block"))
        if blocks <= 1:
            break
        blocks = -(-blocks // block)
    last = (F.col("part") >= 0.5).cast("long")  # one document a source is left, and goes to the nearer whole number
    ready.append(level.select(*source, *kept, (F.col("whole") + last).alias("total")))
    return reduce(DataFrame.unionByName, ready)


def share_of(place: Column, n: Column, total: Column) -> Column:
    """Copies of the row at ``place`` (from 0) of ``n`` equal rows that get ``total`` together."""
    return F.floor(total / n).cast("long") + (place < total % n).cast("long")


#: What makes rows equal for the mix: a repeated id with another text is another document.
UNIT = ["doc_id", "source", "size", "text_hash"]


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row: the words that the mix takes of it, repeats counted."""
    plan = copies(staged(sized_rows(docs), "mix-sizes"), **options)
    rows = repeated(plan, "n", "place")
    return rows.select("doc_id", "size", "source_size", "target", (share_of(F.col("place"), F.col("n"), F.col("total")) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as its copies say, with the columns of ``docs``.

    Rows equal in id, source and text share their copies. Those that are equal in all columns are counted before they
    move; others among them come in the order of a hash of all columns, so reruns agree.
    """
    plan = copies(staged(sized_rows(docs, id_col, text_col, source_col), "mix-sizes"), **options).filter("total > 0")
    unit, times, alike, before = (free_name(docs, x) for x in ("mix_unit", "mix_times", "mix_alike", "mix_before"))
    key = [F.col(id_col), F.col(source_col), word_count(F.col(text_col)), F.xxhash64(text_col)]
    rows = docs.withColumn(unit, F.xxhash64(*key))
    names = [free_name(docs, f"plan_{c}") for c in (*UNIT, "n", "total")]
    plan = plan.select(*UNIT, "n", "total").toDF(*names)
    p = dict(zip((*UNIT, "n", "total"), names))
    place = free_name(rows, "plan_place")
    plan = plan.withColumn(place, F.xxhash64(*[p[c] for c in UNIT]))
    same = (rows[unit] == plan[place]) & rows[id_col].eqNullSafe(plan[p["doc_id"]]) & rows[source_col].eqNullSafe(plan[p["source"]])
    same = same & (F.xxhash64(rows[text_col]) == plan[p["text_hash"]])

    single = rows.join(plan.filter(F.col(p["n"]) == 1), same).withColumn(times, F.col(p["total"])).select(*docs.columns, times)
    equal = rows.join(plan.filter(F.col(p["n"]) > 1), same).groupBy(*docs.columns, unit, p["n"], p["total"]).agg(F.count(F.lit(1)).alias(alike))
    order = Window.partitionBy(unit).orderBy(F.xxhash64(*docs.columns))
    equal = equal.withColumn(before, F.sum(alike).over(order) - F.col(alike))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col(alike), F.col(p["total"]) % F.col(p["n"]) - F.col(before)))
    several = equal.withColumn(times, F.col(alike) * F.floor(F.col(p["total"]) / F.col(p["n"])).cast("long") + extra).select(*docs.columns, times)
    number = free_name(docs, "mix_number")
    return repeated(single.unionByName(several), times, number).select(*docs.columns)
