"""Filter interaction audit: what each filter removes at each place of every order."""
from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurelens.llm.tables import cuts, partitions_for, stored

#: Failing ids of all filters in a task, about.
TASK_ROWS = 400_000


def text_filters() -> dict[str, Callable[[Column], Column]]:
    """Filters on one text alone: the condition under which it fails."""
    words = lambda t: F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = "".join(map(chr, range(65, 91)))
    return {"A": lambda t: F.size(words(t)) < 50,
            "B": lambda t: F.size(F.array_distinct(words(t))) * 100 < F.size(words(t)) * 65,
            "C": lambda t: (F.length(t) - F.length(F.translate(t, capitals, ""))) * 100 > F.length(t) * 5,
            "D": lambda t: t.rlike("[#$%&*|]")}


def failing_ids(docs: DataFrame, filters: Mapping[str, Callable[[Column], Column]], repeated: str, id_col: str, text_col: str, part_col: str) -> tuple[DataFrame, DataFrame]:
    """The stored relations of failing ids, one folder per ``filter``, and the number of documents of each ``part``.

    ``key`` is the digest of the text with the id, so rows with equal ids but different texts are told apart; ``n`` rows are
    equal in both.  ``repeated`` names the filter that fails a text which a smaller id has too.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # the texts are read once; everything after works on these narrow rows
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = [F.when(fn(F.col("text")), F.lit(name)) for name, fn in filters.items()]
    judged = stored(read.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.array_compact(F.array(*fails)).alias("fails")), "judged")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    after = F.when(F.col("doc_id") > F.col("first_id"), F.array(F.lit(repeated))).otherwise(F.array().cast("array<string>"))
    rows = judged.join(first, "digest", "left").select("part", "doc_id", F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
                                                       F.explode(F.concat("fails", after)).alias("filter"))
    found = stored(rows.groupBy("filter", "part", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "failing", by="filter")
    return found, judged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def removals(found: DataFrame, names: list[str], marks: Mapping[str, DataFrame]) -> DataFrame:
    """``n`` documents that ``filter`` removes after the set ``before`` (a sum of bits), per part and ``mark``.

    The failing ids of each filter (all of them, and by left-semi joins those with a mark) go through one left-anti join per
    other filter, with and without it in the set: what a set leaves of a filter's failing ids is what the filter still removes.
    """
    spark = found.sparkSession
    parts = partitions_for(spark, cuts(found.count(), TASK_ROWS))
    rows = found.select("filter", "part", "doc_id", "key", "n")
    marked = [rows.withColumn("mark", F.lit(""))] + [rows.join(ids, "doc_id", "left_semi").select(*rows.columns).withColumn("mark", F.lit(m)) for m, ids in marks.items()]
    state = reduce(DataFrame.unionByName, marked).drop("doc_id").repartition(parts, "key").withColumn("before", F.lit(0))
    for i, name in enumerate(names):
        bit = 1 << i
        sets = F.when(F.col("filter") == name, F.array("before")).otherwise(F.array("before", F.col("before") + bit))
        state = state.withColumn("before", F.explode(sets))
        relation = found.where(F.col("filter") == name).select(F.col("key").alias("failing")).repartition(parts, "failing").hint("shuffle_hash")
        state = state.join(relation, (F.col("key") == F.col("failing")) & (F.col("before").bitwiseAND(bit) != 0), "left_anti")
    return state.groupBy("part", "mark", "filter", "before").agg(F.sum("n").alias("n"))


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column]] | None = None, repeated: str = "E",
                 id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters, and step, with what the step's filter does there.

    ``kept`` documents of the part after the step, ``removed`` in it, ``redundant`` (failing the filter, but removed before),
    ``unique_fails`` (failing this filter only), ``good_lost`` and ``toxic_lost`` (removed here, with a label ``quality`` or ``toxic`` of 1),
    and ``shapley``, the filter's removals added up over all orders.  Every order of the filters comes with every part, also where
    all is zero.

    What a filter removes depends only on the set applied before it, so the joins run once per set; the orders are read off
    the counts of each part.  Counts per part are a row of at most filters x sets x marks numbers.

    Nulls: a null text is empty, a null part is the part '', a null id has no label, and repeats nothing and is repeated by
    nothing.  Rows with equal ids are each a document; they don't repeat each other.  Several labels of an id: one that says 1 is
    enough.  Empty table: no rows.  Columns not named are left out, so their names can't clash.
    """
    filters = dict(text_filters() if filters is None else filters)
    names = [*filters, repeated]
    found, sizes = failing_ids(docs, filters, repeated, id_col, text_col, part_col)
    marks = {m: labels.where(F.col(c) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct() for m, c in (("good", "quality"), ("toxic", "toxic"))}
    counts = removals(found, names, marks).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "mark", "filter", F.col("before").cast("string")), "n"))).alias("counts"))
    every = sizes.join(counts.withColumnRenamed("part", "of_part"), F.col("part") == F.col("of_part"), "left")

    def count(mark, name, before):
        key = F.concat_ws("|", F.lit(mark), name, before.cast("string"))
        return F.coalesce(F.try_element_at(F.col("counts"), key), F.lit(0))

    bit = {n: 1 << i for i, n in enumerate(names)}
    sets = sorted((sum(bit[n] for n in c), c) for k in range(len(names) + 1) for c in combinations(names, k))
    left = F.array(*[reduce(lambda a, b: a - b, [count("", F.lit(n), F.lit(sum(bit[m] for m in c[:i]))) for i, n in enumerate(c)], F.col("n")) for _, c in sets])
    weight = lambda c: factorial(len(c)) * factorial(len(names) - 1 - len(c))
    value = {n: reduce(lambda a, b: a + b, [count("", F.lit(n), F.lit(s)) * weight(c) for s, c in sets if n not in c]) for n in names}
    per_part = every.select("part", "counts", left.alias("left"), F.create_map(*[x for n in names for x in (F.lit(n), value[n])]).alias("value"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    steps = per_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(names))])))
    name = F.expr("substring(filter_order, step, 1)")
    before = reduce(lambda a, b: a + b, [F.when(F.instr("filter_order", n) < F.col("step"), bit[n]).otherwise(0) for n in names])
    own = reduce(lambda a, b: a + b, [F.when(F.col("name") == n, bit[n]).otherwise(0) for n in names])
    steps = steps.withColumn("name", name).withColumn("before", before).withColumn("own", own)
    removed, others = count("", F.col("name"), F.col("before")), F.lit(2 ** len(names) - 1) - F.col("own")
    return steps.select(
        "part", "filter_order", "step", F.element_at("left", F.col("before") + F.col("own") + 1).cast("long").alias("kept"), removed.alias("removed"),
        (count("", F.col("name"), F.lit(0)) - removed).alias("redundant"), count("", F.col("name"), others).alias("unique_fails"),
        count("good", F.col("name"), F.col("before")).alias("good_lost"), count("toxic", F.col("name"), F.col("before")).alias("toxic_lost"),
        F.element_at("value", F.col("name")).cast("long").alias("shapley"))


ORACLE_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
f as (select part, (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
        + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask,
        (doc_id in (select doc_id from labels where quality = 1 and doc_id is not null))::int as good,
        (doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null))::int as bad from w),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(bad, 0)) as bad from f group by part, mask),
l(name, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select a.name || b.name || x.name || y.name || z.name as filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] as bits
      from l a, l b, l x, l y, l z where a.bit + b.bit + x.bit + y.bit + z.bit = 31 and (a.bit | b.bit | x.bit | y.bit | z.bit) = 31),
s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (select part, filter_order, step, own,
        coalesce(sum(n) filter (mask & (before | own) = 0), 0) as kept, coalesce(sum(n) filter (mask & before = 0 and mask & own > 0), 0) as removed,
        coalesce(sum(n) filter (mask & before > 0 and mask & own > 0), 0) as redundant, coalesce(sum(n) filter (mask = own), 0) as unique_fails,
        coalesce(sum(good) filter (mask & before = 0 and mask & own > 0), 0) as good_lost,
        coalesce(sum(bad) filter (mask & before = 0 and mask & own > 0), 0) as toxic_lost
      from c, s group by part, filter_order, step, own)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r"""
