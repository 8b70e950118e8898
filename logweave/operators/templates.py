"""Template mining and the template dictionary.

Templates are the masked, whitespace-collapsed lines, grouped exactly. For lines under ten
tokens this is the same grouping a similarity-0.9 prefix-tree miner produces (one differing
token gives at most 8/9 < 0.9); longer lines are clustered in ``similar_templates``. The dictionary is an aggregate (one row per template); its
size is bounded by the number of distinct log statements, not by the data volume.

Joins against the dictionary are left to AQE: it sees the measured size of the aggregated
dictionary at runtime and broadcasts it only when it is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.ranking import rank_ordered
from logweave.session import cut_lineage

SPLIT_ORDER = ["train", "val", "dev", "fewshot", "test"]


def split_rank(split_col: str = "split"):
    """Position of a split in the fixed split order (unknown splits last)."""
    expr = F.lit(len(SPLIT_ORDER))
    for i, s in reversed(list(enumerate(SPLIT_ORDER))):
        expr = F.when(F.col(split_col) == s, F.lit(i)).otherwise(expr)
    return expr


def mine_templates(lines: DataFrame, template: str = "template") -> DataFrame:
    """One row per template: count and first occurrence (time, line number)."""
    return lines.groupBy(template).agg(
        F.count("*").alias("count"),
        F.min(F.struct("ts", "line_no")).alias("first"))


def template_dictionary(lines: DataFrame, split_col: str | None = "split",
                        template: str = "template", key: str = "trace_id") -> DataFrame:
    """Global ids: templates of the train split in order of first appearance in its log, then
    those first seen in later splits, in split order, there trace by trace (traces in order of
    their first line) and line by line; plus total count, train count and the seen flag.

    One aggregate over the lines gives counts and the train order. Only templates that train lacks
    need the start of a trace, so only their lines and traces are looked up.
    """
    sr = split_rank(split_col) if split_col else F.lit(0)
    is_train = (F.col(split_col) == "train") if split_col else F.lit(True)
    here = F.struct(F.col("ts").alias("ts"), F.col("line_no").alias("line_no"))

    def first(rank: Column, group: Column, line: Column) -> Column:
        return F.struct(rank.cast("int").alias("sr"), group.alias("group"), line.alias("here"))

    counted = cut_lineage(lines.groupBy(template).agg(
        F.min(F.when(is_train, here)).alias("_train"), F.count("*").alias("count"),
        F.count_if(is_train).alias("train_count")), "templates")
    in_train = F.col("_train").isNotNull()
    counts = [template, "count", "train_count"]
    d = counted.where(in_train).select(*counts, first(F.lit(0), F.col("_train"), F.col("_train")).alias("first"))
    late = counted.where(~in_train)
    if not late.isEmpty():
        their = lines.join(late.select(template), template)
        began = lines.join(their.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(here).alias("_began"))
        place = their.join(began, key).groupBy(template).agg(F.min(first(sr, F.col("_began"), here)).alias("first"))
        d = d.unionByName(late.select(*counts).join(place, template))
    d = rank_ordered(d, [], [F.col("first")], out="id")
    return d.select(
        F.col("id").cast("long").alias("id"), F.col(template).alias("text"), "count", "train_count",
        (F.col("train_count") > 0).alias("seen_in_train"))


def join_template_ids(lines: DataFrame, dictionary: DataFrame,
                      template: str = "template") -> DataFrame:
    """Attach the global template id to each line (equi-join on the template text)."""
    d = dictionary.select(F.col("text").alias(template), F.col("id").alias("template_id"),
                          "seen_in_train")
    return lines.join(d, template, "left")


def unseen_template_traces(lines_with_ids: DataFrame, key: str | tuple[str, ...] = "trace_id") -> DataFrame:
    """Traces that hold at least one template never seen in train."""
    return (lines_with_ids.groupBy(*([key] if isinstance(key, str) else key))
            .agg(F.count_if(~F.col("seen_in_train")).alias("n_unseen_lines"),
                 F.count("*").alias("n_lines"))
            .where(F.col("n_unseen_lines") > 0))


def template_csv_rows(dictionary: DataFrame) -> DataFrame:
    """``T%03d, count, template`` rows of the template list file, and the id to order them by."""
    return dictionary.select("id", F.format_string("T%03d", F.col("id")).alias("template_id"),
                             "count", F.col("text").alias("template"))
