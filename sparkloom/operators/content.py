"""Labelled content: the unified view, filters, counts, shares and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, joined_text


def with_results(content: DataFrame, results: DataFrame, content_type: str) -> DataFrame:
    """Left join on the id; the constant content type belongs to the join, not to a filter after it."""
    own = results.where(F.col("content_type") == content_type).select("content_id", "sentiment_label", "sentiment_score")
    return content.join(own, content["id"] == own["content_id"], "left").withColumn("content_type", F.lit(content_type))


def unified(posts: DataFrame, comments: DataFrame, results: DataFrame) -> DataFrame:
    """Posts and comments with their labels in one table."""
    columns = ["id", "subreddit", "text", "score", "content_type", "sentiment_label", "sentiment_score"]
    p = with_results(posts.withColumn("text", joined_text(F.col("title"), F.col("body"))), results, "post")
    c = with_results(comments.withColumnRenamed("body", "text"), results, "comment")
    return p.select(*columns).unionByName(c.select(*columns))


def topic_texts(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """(id, subreddit, text, clean) for topic models; nulls count as empty, texts that clean to nothing go."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    both = posts.select("id", "subreddit", text.alias("text")).unionByName(comments.select("id", "subreddit", F.coalesce("body", F.lit("")).alias("text")))
    return both.withColumn("clean", clean_text(F.col("text"))).where("clean <> ''")


def filtered(content: DataFrame, groups: list[str] | None = None, types: list[str] | None = None, start: str | None = None, end: str | None = None, labelled: bool = False) -> DataFrame:
    """All conditions that are given, dates inclusive."""
    if groups:
        content = content.where(F.col("subreddit").isin(groups))
    if types:
        content = content.where(F.col("content_type").isin(types))
    if start and end:
        content = content.where(F.to_date("created_dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return content.where(F.col("sentiment_label").isNotNull()) if labelled else content


def label_pivot(content: DataFrame, labels: list[str]) -> DataFrame:
    """Counts by group, a column per label, 0 where there are none."""
    known = content.where(F.col("sentiment_label").isNotNull())
    return known.groupBy("subreddit").pivot("sentiment_label", labels).agg(F.count(F.lit(1))).na.fill(0)


def label_counts(content: DataFrame) -> DataFrame:
    return content.where(F.col("sentiment_label").isNotNull()).groupBy("subreddit", "sentiment_label").agg(F.count(F.lit(1)).alias("cnt"))


def trend(content: DataFrame, unit: str) -> DataFrame:
    """Counts by period (day, week from Monday, month) and label."""
    period = F.date_trunc(unit, "created_dt").cast("timestamp_ntz").alias("period")
    return content.where(F.col("sentiment_label").isNotNull()).groupBy(period, "sentiment_label").agg(F.count(F.lit(1)).alias("cnt"))


def share(counts: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """Each count's part of its group's total."""
    return counts.withColumn("share", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy(by)), digits))


def kpis(content: DataFrame) -> DataFrame:
    """Rows, distinct groups, labelled rows and the commonest label (ties: the first by name)."""
    totals = content.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("subreddit").alias("groups"), F.count("sentiment_label").alias("labelled"))
    top = content.where(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sentiment_label").limit(1)
    return totals.join(top.select(F.col("sentiment_label").alias("top_label")), how="left")


def date_bounds(content: DataFrame) -> DataFrame:
    return content.agg(F.to_date(F.min("created_dt")).alias("first_day"), F.to_date(F.max("created_dt")).alias("last_day"))


def top_by_score(content: DataFrame, n: int) -> DataFrame:
    return content.orderBy(F.desc("score"), "id").limit(n)


def recent(content: DataFrame, n: int) -> DataFrame:
    return content.orderBy(F.desc("created_dt"), "id").limit(n)


def first_per_group(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)


def top_comments(comments: DataFrame, n: int = 5) -> DataFrame:
    """The first n comments of each post, and of these the ones that aren't deleted, removed or empty."""
    first = first_per_group(comments, ["post_id"], [F.col("turn")], n)
    return first.where(~F.col("body").isin("[deleted]", "[removed]", "")).drop("rn")


def label_words(content: DataFrame, n: int, least: int = 4) -> DataFrame:
    """The commonest words of each label's texts."""
    known = content.where(F.col("sentiment_label").isNotNull()).select("sentiment_label", F.explode(F.split(clean_text(F.col("text")), r"\s+")).alias("word"))
    counts = known.where(F.length("word") >= least).groupBy("sentiment_label", "word").agg(F.count(F.lit(1)).alias("cnt"))
    return first_per_group(counts, ["sentiment_label"], [F.desc("cnt"), F.col("word")], n)


#: Days that a listing's time filter goes back; all has no limit.
TIME_FILTERS = {"day": 1, "week": 7, "month": 30, "year": 365, "all": None}


def listing(posts: DataFrame, comments: DataFrame, now: str, time_filter: str = "month", limit: int = 100, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(posts, comments) as a listing gives them: the best ``limit`` posts since the filter's start, and the first
    ``n`` comments of each that aren't deleted.

    ``posts`` has created_utc in seconds, ``comments`` post_id and turn.
    """
    from ..functions.text import from_epoch

    days = TIME_FILTERS[time_filter]
    since = posts if days is None else posts.where(from_epoch(F.col("created_utc")) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    top = top_by_score(since, limit)
    return top, top_comments(comments.join(top.select(F.col("id").alias("post_id")), "post_id", "left_semi"), n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table in one result."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("name"), "cnt")
        out = one if out is None else out.unionByName(one)
    return out


def collect_sources(sources: dict, columns: str) -> tuple[DataFrame | None, dict[str, str]]:
    """The union of what the sources' loaders give, and the errors of those that failed."""
    out, errors = None, {}
    for name, load in sources.items():
        try:
            df = load()
            df.schema  # analysis errors of a source show here
        except Exception as e:  # a failing source doesn't stop the others
            errors[name] = str(e).splitlines()[0]
            continue
        out = df if out is None else out.unionByName(df)
    return out, errors
