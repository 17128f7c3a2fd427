"""Mixing sources to target weights, with DataFrame functions alone."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenurelens.llm.tables import stored

#: Bits of a document's random key.
KEY_BITS = 60


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), percent: float = 100.0, most: int = 3) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source (``source``, ``source_size``).

    Sources in code-point order (null last) take the ``weights`` in turn.  All sources share ``percent`` of all
    words by weight; a target stops at ``most`` times its source's size, and what is above goes to the others.  In the
    order of size by weight the sources that stop come first, so running sums tell where the stopping ends:
    a source stops when its limit is no more than its share of what the ones before it leave.
    """
    turn = F.pmod(F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn.cast("int") + 1))
    limit = F.lit(most) * F.col("source_size")
    up = W.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    whole = W.partitionBy()
    before, exact = up.rowsBetween(W.unboundedPreceding, -1), "decimal(38,0)"
    all_words = F.sum("source_size").over(whole).cast("double") * percent / 100
    left = all_words - F.coalesce(F.sum(limit).over(before), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    judged = weighed.withColumn("limit", limit).withColumn("stops", limit * open_weight <= F.col("weight") * left).withColumn("all_words", all_words)
    rest = F.col("all_words") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("limit"))).over(whole), F.lit(0))
    share = F.sum(F.when(~F.col("stops"), F.col("weight"))).over(whole)
    return judged.withColumn("target", F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("weight") * rest / share)).drop("limit", "stops", "all_words")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), percent: float = 100.0, most: int = 3, seed: int = 2024,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes: ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``taken``.

    A document's size is its number of words (none for a null text).  Each source's documents stand in the order of a
    random key, which is a hash of ``seed`` and the id.  A source is taken whole as often as its target holds it, then once more
    from the start of that order up to the budget's last word: the document at the cut gives its first words only, so
    that ``taken`` of a source adds up to its target without the fraction.

    The keys are spread evenly, so equal ranges of them are the parts of a range sort: a source has about as many
    ranges as the square root of its rows.  Words per range are added up along the ranges, and within a range along the keys, so
    a source with most of the rows is many small sorts.

    Nulls: a null source is a source of its own, the last one; a null id takes its key from the text.  Repeated rows and ids are each mixed
    as a document of their own, equal ones in an arbitrary order that doesn't show in the rows.  A source without words has
    target 0.  Columns other than the three are left out, so their names can't clash.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text, key = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.sha2(F.col(text_col).cast("string"), 256), F.lit(""))
    sized = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    budget = F.floor("target")
    whole_times = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    sources = source_targets(sizes, weights, percent, most).withColumn("times", whole_times).select(
        F.col("source").alias("of_source"), "source_size", "target", "times", (budget - F.col("times") * F.col("source_size")).alias("rest"),
        F.ceil(F.log2(F.col("rows").cast("double")) / 2).cast("int").alias("bits"), F.row_number().over(W.orderBy("source")).alias("number"))
    sources = stored(sources, "sources")
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("range", F.expr(f"shiftright(key, {KEY_BITS} - bits)"))
    up = W.partitionBy("number").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("number", "range").agg(F.sum("size").alias("words")).select(
        "number", "range", F.coalesce(F.sum("words").over(up), F.lit(0)).alias("range_start"))
    inside = W.partitionBy("number", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    cut = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["number", "range"])
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("range_start") - F.col("inside")))
    return cut.select("doc_id", "size", "source", "source_size", "target", (F.col("times") * F.col("size") + last).cast("long").alias("taken"))


ORACLE_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                  ('0x' || substr(sha256('2024:' || doc_id), 1, 15))::bigint as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as weight from s),
r as (select *, 3 * source_size as lim, (sum(source_size) over ())::double * 100 / 100 as total, sum(weight) over () as weights,
             coalesce(sum(3 * source_size) over b, 0) as lims, coalesce(sum(weight) over b, 0) as done
      from w window b as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
j as (select *, lim * (weights - done) <= weight * (total - lims) as stops from r),
t as (select source, source_size, case when stops then lim::double
             else weight * (total - coalesce(sum(case when stops then lim end) over (), 0)) / sum(case when not stops then weight end) over () end as target from j),
c as (select doc_id, size, d.source, source_size, target, floor(target)::bigint as budget,
             case when source_size > 0 then floor(target)::bigint // source_size else 0 end as times,
             coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source, source_size, target,
       (times * size + greatest(0, least(size, budget - times * source_size - before)))::bigint as taken from c"""
