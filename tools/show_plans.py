"""Print scan pruning, pushed filters and join strategies of registered queries.

Usage: python tools/show_plans.py [sf_dir] [query ...]
"""
import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])
from logweave.session import get_spark
from logweave.plans.catalog import QUERIES
spark = get_spark("local[8]", 8)
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or ["keyword_match", "flow_conformance", "classification_metrics",
                         "range_anti_incident", "drop_background", "trace_interleaving"]
for name in names:
    df = QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    p = df._jdf.queryExecution().executedPlan().toString()
    scans = set(re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))
    pushed = set(re.findall(r"PushedFilters: (\[[^\]]*\])", df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))
    joins = {j: p.count(j) for j in ["BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "ShuffledHashJoin"] if p.count(j)}
    print(name, "| scans:", scans, "| pushed:", pushed, "| joins:", joins)
