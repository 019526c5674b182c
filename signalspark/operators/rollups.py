"""Business figures over raw shop and repository tables, and their snapshot rows."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalspark.functions.ranges import _typed_literal

LOW_STOCK = 10
MONEY = "decimal(38,6)"


def _at(df: DataFrame, ts: str, moment: datetime) -> Column:
    return _typed_literal(moment, df.schema[ts].dataType)


def _since(df: DataFrame, ts: str, as_of: datetime, days: int) -> Column:
    """Within the last ``days`` days up to ``as_of``."""
    return (F.col(ts) >= _at(df, ts, as_of - timedelta(days=days))) & (F.col(ts) <= _at(df, ts, as_of))


def _today(df: DataFrame, ts: str, as_of: datetime) -> Column:
    start = datetime.combine(as_of.date(), time())
    return (F.col(ts) >= _at(df, ts, start)) & (F.col(ts) <= _at(df, ts, as_of))


def _amount(df: DataFrame, column: str) -> Column:
    """A price as an exact decimal; text that is no number counts as missing."""
    kind = df.schema[column].dataType
    value = F.col(column).cast("string") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(column)
    return value.try_cast(MONEY)


def _total(amount: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, amount)), F.lit(0)).cast("double")


def order_counts(orders: DataFrame, as_of: datetime, days: int = 30, ts: str = "created_at") -> DataFrame:
    return orders.agg(
        F.count(F.lit(1)).alias("orders_total"),
        F.count_if(_today(orders, ts, as_of)).alias("orders_today"),
        F.count_if(_since(orders, ts, as_of, days)).alias(f"orders_{days}d"),
    )


def revenue(
    orders: DataFrame, as_of: datetime, days: int = 30, ts: str = "created_at", price: str = "total_price"
) -> DataFrame:
    amount = _amount(orders, price)
    return orders.where(_since(orders, ts, as_of, max(days, 1))).agg(
        _total(amount, _today(orders, ts, as_of)).alias("revenue_today"),
        _total(amount, _since(orders, ts, as_of, days)).alias(f"revenue_{days}d"),
    )


def avg_order_value(
    orders: DataFrame, as_of: datetime, days: int = 30, ts: str = "created_at", price: str = "total_price"
) -> DataFrame:
    """Revenue per order of the period, over all its orders; 0 when there are none."""
    recent = orders.where(_since(orders, ts, as_of, days))
    figures = recent.agg(F.count(F.lit(1)).alias("n"), _total(_amount(orders, price), F.lit(True)).alias("revenue"))
    average = F.when(F.col("n") > 0, F.col("revenue") / F.col("n")).otherwise(F.lit(0.0))
    return figures.select(average.alias("average_order_value"))


def product_counts(products: DataFrame, status: str = "status") -> DataFrame:
    return products.agg(
        F.count(F.lit(1)).alias("products_total"),
        F.count_if(F.col(status) == "active").alias("products_active"),
    )


def unfulfilled(orders: DataFrame, status: str = "status", fulfillment: str = "fulfillment_status") -> DataFrame:
    """Open orders that nothing has been shipped for."""
    waiting = (F.col(status) == "open") & (F.coalesce(fulfillment, F.lit("unfulfilled")) == "unfulfilled")
    return orders.agg(F.count_if(waiting).alias("unfulfilled_orders"))


def refunds(orders: DataFrame, as_of: datetime, days: int = 30, ts: str = "created_at") -> DataFrame:
    """Refunds of recent orders: ``refunds`` is an array of structs with an array ``transactions`` of amounts."""
    each = orders.where(_since(orders, ts, as_of, days)).select(F.explode("refunds").alias("refund"))
    # Sums within a refund first, so that no row is made per transaction.
    amounts = F.transform("refund.transactions", lambda t: F.coalesce(t["amount"].try_cast(MONEY), F.lit(0).cast(MONEY)))
    total = F.aggregate(amounts, F.lit(0).cast(MONEY), lambda a, b: (a + b).cast(MONEY))
    return each.select(total.alias("amount")).agg(
        F.count(F.lit(1)).alias(f"refunds_{days}d"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias(f"refund_amount_{days}d"),
    )


def inventory(levels: DataFrame, available: str = "available") -> DataFrame:
    """Items in stock, negative levels counting as none, and levels that run low."""
    quantity = F.col(available)
    return levels.agg(
        F.coalesce(F.sum(F.greatest(quantity, F.lit(0))), F.lit(0)).cast("bigint").alias("inventory_items"),
        F.count_if((quantity > 0) & (quantity < LOW_STOCK)).alias("low_stock_count"),
    )


def abandoned(checkouts: DataFrame, completed: str = "completed_at") -> DataFrame:
    return checkouts.agg(F.count_if(F.col(completed).isNull()).alias("abandoned_checkouts"))


def customer_counts(customers: DataFrame, as_of: datetime, days: int = 30, ts: str = "created_at") -> DataFrame:
    return customers.agg(
        F.count(F.lit(1)).alias("customers_total"),
        F.count_if(_since(customers, ts, as_of, days)).alias(f"customers_{days}d"),
    )


def repo_facts(repos: DataFrame, ts: str = "updated_at") -> DataFrame:
    """The newest known facts of every repository."""
    facts = ["stars", "forks", "watchers", "open_issues", "size_kb", "default_branch"]
    newest = repos.groupBy("entity").agg(F.max(F.struct(ts, *facts)).alias("row"))
    return newest.select("entity", *[F.col(f"row.{name}").alias(name) for name in facts])


def commit_stats(commits: DataFrame, as_of: datetime, days: int = 30, ts: str = "committed_at") -> DataFrame:
    """Commits of the last days and the time of the last one, per repository."""
    recent = commits.where(_since(commits, ts, as_of, days))
    return recent.groupBy("entity").agg(
        F.count(F.lit(1)).alias(f"commits_{days}d"), F.max(ts).alias("last_commit_at")
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues open and closed, pull requests open, closed and merged, per repository."""
    pull, is_open, closed = F.col("is_pull_request"), F.col("state") == "open", F.col("state") == "closed"
    return issues.groupBy("entity").agg(
        F.count_if(~pull & is_open).alias("issues_open"),
        F.count_if(~pull & closed).alias("issues_closed"),
        F.count_if(pull & is_open).alias("prs_open"),
        F.count_if(pull & closed).alias("prs_closed"),
        F.count_if(pull & F.col("merged")).alias("prs_merged"),
    )


def select_metrics(df: DataFrame, names: Iterable[str] | None, keep: tuple[str, ...] = ("entity",)) -> DataFrame:
    """Only the named figures; without names, all of them."""
    if names is None:
        return df
    wanted = set(names)
    return df.select(*[c for c in df.columns if c in keep or c in wanted])


def to_snapshots(df: DataFrame, connector: str, as_of: datetime, entity: str | None = None) -> DataFrame:
    """Figures as snapshot rows; missing ones are left out of the JSON."""
    figures = [c for c in df.columns if c != "entity"]
    name = F.col("entity") if entity is None else F.lit(entity)
    return df.select(
        _typed_literal(as_of, T.TimestampNTZType()).alias("timestamp"),
        F.lit(connector).alias("connector"),
        name.alias("entity"),
        F.to_json(F.struct(*figures)).alias("metrics"),
    )
