"""Costs, budgets and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions import regex
from cinderlog.settings import DEFAULTS, Settings
from cinderlog.workers import materialised

MONEY = "decimal(18,6)"


def project_context(projects: DataFrame, team_id: int | None = None) -> DataFrame:
    """Projects that aren't deleted, of one team or all."""
    rows = projects.where("deleted_at IS NULL")
    return rows if team_id is None else rows.where(F.col("team_id") == team_id)


def month_to_date_cost(requests: DataFrame, as_of: Column) -> DataFrame:
    """team_id, spent: the cost of successful requests since the month of as_of began."""
    rows = requests.where((F.col("status") == "success") & (F.col("created_at") >= F.date_trunc("month", as_of)))
    return rows.groupBy("team_id").agg(F.coalesce(F.sum(F.col("cost_usd").cast(MONEY)), F.lit(0).cast(MONEY)).cast("double").alias("spent"))


def budget_status(teams: DataFrame, requests: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """team_id, budget, spent, status: unlimited, ok, warning or exceeded."""
    spent = teams.select(F.col("id").alias("team_id"), F.col("monthly_ai_budget_usd").alias("budget")).join(month_to_date_cost(requests, as_of), "team_id", "left")
    spent = spent.withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    status = (
        F.when(F.coalesce(F.col("budget"), F.lit(0.0)) == 0, "unlimited").when(F.col("spent") >= F.col("budget"), "exceeded")
        .when(F.col("spent") >= F.col("budget") * settings.budget_warning_share, "warning").otherwise("ok")
    )
    return spent.select("team_id", "budget", F.round("spent", 6).alias("spent"), status.alias("status"))


def admitted(requests: DataFrame, budgets: DataFrame, order: list[str], cost: str = "cost_usd", team: str = "team_id") -> DataFrame:
    """requests with `spent_before` and `admitted`: whether its team had budget left when the request's turn came.

    As if requests were taken one after another, in `order`: a request is admitted while what its team has spent this
    month and what it admitted before add up to less than the budget. Costs are 0 or more (null counts as 0), so once a team's
    running cost reaches the budget all its later requests are refused, and those before them were all admitted: the
    running cost is the sum over all earlier requests. budgets: team_id, budget, spent; without a budget all are admitted.

    The sums are made in segments: requests are dealt by ranges of (team, order), each range adds up its part of a team,
    and these few totals are carried over; so a team that has most requests is added up by many tasks.
    """
    keys = [F.col(x) for x in (team, *order)]
    paid = F.greatest(F.coalesce(F.col(cost).cast(MONEY), F.lit(0).cast(MONEY)), F.lit(0).cast(MONEY))
    rows = requests.withColumn("__paid", paid).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__range", F.spark_partition_id())
    rows = materialised(rows)
    earlier = Window.partitionBy(team).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(team, "__range").agg(F.sum("__paid").alias("__sum"))
    ranges = ranges.select(F.col(team).alias("__team"), F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__carried"))
    own = Window.partitionBy(team, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("__paid").over(own), F.lit(0)))
    limits = budgets.select(F.col("team_id").alias("__owner"), F.col("budget").cast(MONEY).alias("__budget"), F.col("spent").cast(MONEY).alias("__spent"))
    rows = rows.join(ranges, F.col(team).eqNullSafe(F.col("__team")) & (F.col("__range") == F.col("__of"))).join(limits, F.col(team) == F.col("__owner"), "left")
    before = F.coalesce(F.col("__spent"), F.lit(0)) + F.col("__carried") + F.col("__before")
    free = F.coalesce(F.col("__budget"), F.lit(0)) == 0
    return rows.select(*requests.columns, before.cast(MONEY).alias("spent_before"), (free | (before < F.col("__budget"))).alias("admitted"))


def upsert_embeddings(target: DataFrame, changes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """target after changes by (failure_id, model): rows that exist get a new embedding and source_text only.

    Write the result to another path, then swap; on a table format with MERGE use its own.
    """
    keys = ["failure_id", "model"]
    changes = changes.dropDuplicates(keys).withColumn("source_text", regex.head(F.col("source_text"), settings.source_text_chars))
    t, c = target.alias("t"), changes.alias("c")
    on = (F.col("t.failure_id") == F.col("c.failure_id")) & (F.col("t.model") == F.col("c.model"))
    there, new = F.col("t.failure_id").isNotNull(), F.col("c.failure_id").isNotNull()

    def pick(name: str) -> Column:
        if name in ("embedding", "source_text"):
            return F.when(new, F.col(f"c.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
        return F.when(there, F.col(f"t.{name}")).otherwise(F.col(f"c.{name}")).alias(name)

    return t.join(c, on, "full_outer").select(*(pick(x) for x in target.columns))


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Dollars for tokens at rates per thousand, to six decimals."""
    return F.round(tokens_in / 1000 * F.lit(rate_in) + tokens_out / 1000 * F.lit(rate_out), 6)
