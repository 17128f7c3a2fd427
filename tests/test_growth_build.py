"""The joins of the feature build are spread over several stages, so that a task holds the sorted rows of few of them."""
import re

from conftest import SF

import __spark_entry__ as entry_module


def test_few_joins_share_a_task(spark):
    text = entry_module.queries()["a10_feature_build"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_COL") >= 5
    depth, joins = 0, []
    # down the left side of the tree: joins between two shuffles
    for line in text.split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        if "SortMergeJoin" in line and "person_composite_id" in line and at > depth:
            depth = at
            joins.append("join")
        elif re.search(r"Exchange .*REPARTITION_BY_COL", line) and at > depth:
            depth = at
            joins.append("cut")
    runs = [len(r) for r in re.findall(r"j+", "".join("j" if x == "join" else "c" for x in joins))]
    assert runs and max(runs) <= 8, runs
