"""Scores of retrieval, of parsers and of paired runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_scores(results: DataFrame, k: int) -> DataFrame:
    """Adds recall, precision and reciprocal rank of `found` (ids by rank) against `relevant` (ids).

    Recall is 1 if nothing is relevant. Precision divides by the lesser of k
    and the number found; without any found it is 1 if nothing is relevant,
    else 0.
    """
    top = F.slice("found", 1, k)
    hits = F.size(F.array_intersect(top, "relevant"))
    first = F.array_min(F.filter(F.transform("found", lambda x, i: F.when(F.array_contains("relevant", x), i + 1)), lambda r: r.isNotNull()))
    return results.withColumns({
        "recall": F.when(F.size("relevant") == 0, 1.0).otherwise(hits / F.greatest(F.size("relevant"), F.lit(1))),
        "precision": F.when(F.size("found") == 0, F.when(F.size("relevant") == 0, 1.0).otherwise(0.0)).otherwise(hits / F.greatest(F.least(F.lit(k), F.size("found")), F.lit(1))),
        "reciprocal_rank": F.coalesce(1.0 / first, F.lit(0.0)),
    })


def nearest_ranks(df: DataFrame, key: str, value: str, shares: Sequence[float]) -> DataFrame:
    """Percentiles of each key by the nearest index round(share * (n - 1)) of the sorted values: key, p50, ...; null without values.

    Equal values are counted first, then those of each of 1,024 ranges between
    a key's least and greatest; only the values of the ranges that hold a wanted
    rank are put in order. So no group of values meets in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("all"))
    placed = counts.join(ends, key).withColumn("range", F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("low")) * 1023, F.col("high") - F.col("low"))), F.lit(0)))
    upto = lambda *by: Window.partitionBy(key, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(key, "range").agg(F.sum("n").alias("in_range"), F.first("all").alias("all")).withColumn("before", F.coalesce(F.sum("in_range").over(upto("range")), F.lit(0)))
    wanted = ranges.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", F.round(F.col("share") * (F.col("all") - 1)) - F.col("before"))
    wanted = wanted.where("rank >= 0 and rank < in_range").select(key, "range", "share", "rank")
    inside = placed.select(key, "range", "v", "n").join(wanted.select(key, "range").distinct(), [key, "range"], "left_semi").withColumn("before", F.coalesce(F.sum("n").over(upto("range", "v")), F.lit(0)))
    found = inside.join(wanted, [key, "range"]).where("rank >= before and rank < before + n")
    out = found.groupBy(key).agg(*(F.max(F.when(F.col("share") == p, F.col("v"))).alias(f"p{round(100 * p)}") for p in shares))
    return df.select(key).distinct().withColumnRenamed(key, "key_").join(out, F.col("key_").eqNullSafe(F.col(key)), "left").drop(key).withColumnRenamed("key_", key)


def grade(score: Column) -> Column:
    """Letter of a score of 0 to 100."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def recall_score(pass_rate: Column, mrr: Column, recall: Column) -> Column:
    """Half the pass rate in percent, 30 for the reciprocal rank, 20 for the recall."""
    return 0.5 * pass_rate * 100 + 30 * mrr + 20 * recall


def paired_totals(runs: DataFrame, pair: str, mode: str, modes: Sequence[str], value: Column) -> DataFrame:
    """Totals of a value by mode, over the pairs that have every mode, and the change in percent between the first two."""
    per = runs.groupBy(pair).pivot(mode, list(modes)).agg(F.sum(value))
    whole = per.dropna(subset=list(modes))
    sums = whole.agg(F.count(F.lit(1)).alias("pairs"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in modes])
    return sums.withColumn("change_percent", F.round(F.try_divide(100.0 * (F.col(modes[1]) - F.col(modes[0])), F.col(modes[0])), 4))


#: Categories of queries with their titles.
CATEGORIES = {"A": "A - Basic Search Quality", "B": "B - Hybrid Search Effectiveness", "C": "C - Filtering", "D": "D - Edge Cases", "E": "E - Ranking Quality", "F": "F - Performance"}


def category_summary(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Passed and all queries of each known category that has any: category (its title), passed, total.

    Results (query_id, passed) meet the ground truth (query_id, category); a
    query that is listed twice in a category counts once there.
    """
    titles = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    rows = results.join(truth.select("query_id", F.try_element_at(titles, F.col("category")).alias("category")).where("category is not null").distinct(), "query_id")
    return rows.groupBy("category").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def delta(before: Column, after: Column) -> Column:
    """The change in percent with its sign and one decimal; N/A without a base."""
    change = F.bround(F.try_divide(100.0 * (after - before), before), 1)
    return F.when((before == 0) | before.isNull(), "N/A").otherwise(F.concat(F.when(change > 0, "+").otherwise(""), F.format_string("%.1f%%", change)))


def paired_report(runs: DataFrame, pair: str, mode: str, modes: tuple[str, str], metrics: dict[str, str]) -> DataFrame:
    """A section of markdown per pair, and one of totals: section, markdown. `metrics` are titles by column of `runs`.

    A pair that lacks a mode says so and counts for no total. Sections are put
    together where the data are; only the totals' row meets in one task.
    """
    run = runs.groupBy(pair, mode).agg(*[F.sum(c).alias(c) for c in metrics])
    wide = run.groupBy(pair).pivot(mode, list(modes)).agg(F.max(F.struct(*metrics)))
    head = "\n".join(("", f"| Metric | {modes[0]} | {modes[1]} | Delta |", "|--------|---|---|-------|"))

    def lines(before, after) -> Column:
        number = lambda x: F.format_number(F.coalesce(x, F.lit(0)), 0)
        rows = [F.concat(F.lit(f"| {title} | "), number(before(c)), F.lit(" | "), number(after(c)), F.lit(" | "), delta(before(c), after(c)), F.lit(" |")) for c, title in metrics.items()]
        return F.concat_ws("\n", F.lit(head), *rows)

    of = lambda m: lambda c: F.col(m)[c]
    missing = F.when(F.col(modes[0]).isNull(), modes[0]).when(F.col(modes[1]).isNull(), modes[1])
    body = F.when(missing.isNotNull(), F.concat(F.lit("\n> Missing `"), missing, F.lit("` run. Skipping comparison."))).otherwise(lines(of(modes[0]), of(modes[1])))
    name = F.coalesce(F.col(pair).cast("string"), F.lit(""))
    sections = wide.select(name.alias("section"), F.concat(F.lit("## "), name, F.lit("\n"), body).alias("markdown"))
    both = wide.where(F.col(modes[0]).isNotNull() & F.col(modes[1]).isNotNull())
    totals = both.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(m)[c]).alias(f"{i}_{c}") for i, m in enumerate(modes) for c in metrics]).where("n > 0")
    summary = F.concat(F.lit("## Aggregate\n"), lines(lambda c: F.col(f"0_{c}"), lambda c: F.col(f"1_{c}")))
    return sections.unionByName(totals.select(F.lit("Aggregate").alias("section"), summary.alias("markdown")))


def write_report(sections: DataFrame, path: str) -> None:
    """Writes the sections as markdown text, the totals last."""
    order = F.when(F.col("markdown").startswith("## Aggregate\n"), 1).otherwise(0)
    sections.orderBy(order, "section").select(F.concat("markdown", F.lit("\n"))).write.mode("overwrite").text(path)
