"""Business rollups over orders, line items, parts, customers and suppliers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.base import query, table
from signalspark.operators import rollups as c

AS_OF = datetime(1998, 6, 15, 12)
_AT = "TIMESTAMP '1998-06-15 12:00:00'"
_ORDERS = "(SELECT o_orderkey, o_custkey, o_orderdate AS created_at, o_totalprice AS total_price, o_orderstatus FROM orders)"
_RECENT = f"created_at >= {_AT} - INTERVAL 30 DAY AND created_at <= {_AT}"
_TODAY = f"created_at >= TIMESTAMP '1998-06-15 00:00:00' AND created_at <= {_AT}"
_PRICE = "CAST(total_price AS DECIMAL(18,2))"


def orders(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "o_orderdate AS created_at", "o_totalprice AS total_price",
        "CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS status",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'fulfilled' WHEN '2-HIGH' THEN NULL ELSE 'unfulfilled' END"
        " AS fulfillment_status",
    )


@query(
    "c1_order_counts",
    f"""SELECT count(*) AS orders_total, count(CASE WHEN {_TODAY} THEN 1 END) AS orders_today,
        count(CASE WHEN {_RECENT} THEN 1 END) AS orders_30d FROM {_ORDERS}""",
)
def _(spark, sf):
    return c.order_counts(orders(spark, sf), AS_OF)


@query(
    "c2_revenue",
    f"""SELECT CAST(coalesce(sum(CASE WHEN {_TODAY} THEN {_PRICE} END), 0) AS DOUBLE) AS revenue_today,
        CAST(coalesce(sum(CASE WHEN {_RECENT} THEN {_PRICE} END), 0) AS DOUBLE) AS revenue_30d FROM {_ORDERS}""",
)
def _(spark, sf):
    return c.revenue(orders(spark, sf), AS_OF)


@query(
    "c3_avg_order_value",
    f"SELECT CAST(sum({_PRICE}) AS DOUBLE) / count(*) AS average_order_value FROM {_ORDERS} WHERE {_RECENT}",
)
def _(spark, sf):
    return c.avg_order_value(orders(spark, sf), AS_OF)


@query(
    "c4_product_counts",
    "SELECT count(*) AS products_total, count(CASE WHEN p_type <> 'ECONOMY' THEN 1 END) AS products_active FROM part",
)
def _(spark, sf):
    products = table(spark, sf, "part").selectExpr("CASE p_type WHEN 'ECONOMY' THEN 'draft' ELSE 'active' END AS status")
    return c.product_counts(products)


@query(
    "c5_unfulfilled",
    "SELECT count(*) AS unfulfilled_orders FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'",
)
def _(spark, sf):
    return c.unfulfilled(orders(spark, sf))


@query(
    "c6_refunds",
    f"""SELECT count(*) AS refunds_30d, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS refund_amount_30d
        FROM lineitem JOIN {_ORDERS} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND {_RECENT}""",
)
def _(spark, sf):
    # Returned lines of an order become its refunds: an order has few lines, so each list is short.
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr(
        "l_orderkey AS o_orderkey",
        "named_struct('transactions', array(named_struct('amount', CAST(l_extendedprice AS STRING)),"
        " named_struct('amount', 'n/a'))) AS refund",
    )
    gathered = returned.groupBy("o_orderkey").agg(F.collect_list("refund").alias("refunds"))
    return c.refunds(orders(spark, sf).join(gathered, "o_orderkey"), AS_OF)


@query(
    "c7_inventory",
    """SELECT CAST(sum(greatest(q, 0)) AS BIGINT) AS inventory_items, count(CASE WHEN q > 0 AND q < 10 THEN 1 END)
        AS low_stock_count FROM (SELECT p_size - 5 AS q FROM part)""",
)
def _(spark, sf):
    return c.inventory(table(spark, sf, "part").selectExpr("p_size - 5 AS available"))


@query("c8_abandoned", "SELECT count(*) AS abandoned_checkouts FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    checkouts = table(spark, sf, "orders").selectExpr("CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS completed_at")
    return c.abandoned(checkouts)


@query(
    "c9_customer_counts",
    f"""SELECT count(*) AS customers_total, count(CASE WHEN {_RECENT} THEN 1 END) AS customers_30d
        FROM (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY 1)""",
)
def _(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
    return c.customer_counts(first, AS_OF)


@query(
    "c10_repo_facts",
    """SELECT concat('repo/', c_nationkey) AS entity, arg_max(c_custkey, (c_custkey)) AS stars, max(c_custkey) % 97 AS forks,
        max(c_custkey) % 89 AS watchers, max(c_custkey) % 83 AS open_issues, max(c_custkey) % 1009 AS size_kb,
        arg_max(c_mktsegment, c_custkey) AS default_branch FROM customer GROUP BY c_nationkey""",
)
def _(spark, sf):
    repos = table(spark, sf, "customer").selectExpr(
        "concat('repo/', c_nationkey) AS entity", "c_custkey AS updated_at", "c_custkey AS stars",
        "c_custkey % 97 AS forks", "c_custkey % 89 AS watchers", "c_custkey % 83 AS open_issues",
        "c_custkey % 1009 AS size_kb", "c_mktsegment AS default_branch",
    )
    return c.repo_facts(repos)


@query(
    "c11_commit_stats",
    f"""SELECT concat('repo/', o_custkey % 50) AS entity, count(*) AS commits_30d, max(created_at) AS last_commit_at
        FROM {_ORDERS} WHERE {_RECENT} GROUP BY 1""",
)
def _(spark, sf):
    commits = table(spark, sf, "orders").selectExpr(
        "concat('repo/', o_custkey % 50) AS entity", "o_orderdate AS committed_at"
    )
    return c.commit_stats(commits, AS_OF)


_ISSUE = [
    "concat('repo/', o_custkey % 50) AS entity",
    "o_orderkey % 3 = 0 AS is_pull_request",
    "CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS state",
    "o_orderstatus = 'F' AS merged",
]


@query(
    "c12_issue_counts",
    f"""SELECT entity, count(CASE WHEN NOT is_pull_request AND state = 'open' THEN 1 END) AS issues_open,
        count(CASE WHEN NOT is_pull_request AND state = 'closed' THEN 1 END) AS issues_closed,
        count(CASE WHEN is_pull_request AND state = 'open' THEN 1 END) AS prs_open,
        count(CASE WHEN is_pull_request AND state = 'closed' THEN 1 END) AS prs_closed,
        count(CASE WHEN is_pull_request AND merged THEN 1 END) AS prs_merged
        FROM (SELECT {", ".join(_ISSUE)} FROM orders) GROUP BY 1""",
)
def _(spark, sf):
    return c.issue_counts(table(spark, sf, "orders").selectExpr(*_ISSUE))


@query(
    "c13_selected_metrics",
    f"SELECT count(CASE WHEN {_RECENT} THEN 1 END) AS orders_30d FROM {_ORDERS}",
)
def _(spark, sf):
    return c.select_metrics(c.order_counts(orders(spark, sf), AS_OF), ["orders_30d", "revenue_30d"])


@query(
    "c14_snapshots",
    f"""SELECT {_AT} AS timestamp, 'shop' AS connector, 'main' AS entity, concat('{{"orders_total":', count(*), ',"orders_today":',
        count(CASE WHEN {_TODAY} THEN 1 END), ',"orders_30d":', count(CASE WHEN {_RECENT} THEN 1 END), '}}') AS metrics FROM {_ORDERS}""",
)
def _(spark, sf):
    return c.to_snapshots(c.order_counts(orders(spark, sf), AS_OF), "shop", AS_OF, "main")
