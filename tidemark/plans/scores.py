"""Registered scoring queries; columns of the star schema stand in for the records' fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scores as S
from tidemark.registry import query
from tidemark.session import table

AS_OF = "DATE '1998-12-31'"


def _scored(name: str, source: str, key: str, score, sql: str) -> None:
    """A score over a table, rounded alike in both engines."""
    run = lambda spark, sf: table(spark, sf, source).select(key, F.round(score(), 9).alias("score"))
    query(name, run, f"SELECT {key}, round({sql}, 9) AS score FROM {source}")


def _c(x: str):
    return F.expr(x)


def _day():
    return F.to_date("o_orderdate")


def _as_of():
    return F.lit("1998-12-31").cast("date")


def _fresh(days: int) -> str:
    return f"greatest(0.0, least(1.0, 1 - date_diff('day', CAST(o_orderdate AS DATE), {AS_OF}) / {days}.0))"


_scored("h61_academic", "part", "p_partkey", lambda: S.academic(_c("p_retailprice"), _c("2024 - p_size % 20"), _c("p_size / 50.0D")), "0.4 * least(p_retailprice / 1000, 1.0) + 0.3 * (1 - greatest(0.0, least(1.0, (p_size % 20) / 10))) + 0.3 * (p_size / 50)")
_scored("h62_repository", "orders", "o_orderkey", lambda: S.repository(_c("o_totalprice / 10"), _c("o_custkey"), _day(), _c("o_orderpriority"), _as_of()), f"0.4 * least(o_totalprice / 10 / 10000, 1.0) + 0.3 * least(o_custkey / 1000, 1.0) + 0.2 * {_fresh(365)} + 0.1 * least(length(o_orderpriority) / 200, 1.0)")
_scored("h63_discussion", "orders", "o_orderkey", lambda: S.discussion(F.lit(0.5), _c("o_totalprice / 100"), _day(), F.lit(0.6), _c("o_custkey"), _as_of()), f"0.2 * 0.5 + 0.3 * least(o_totalprice / 100 / 1000, 1.0) + 0.1 * {_fresh(7)} + 0.2 * 0.6 + 0.2 * least(o_custkey / 10000, 1.0)")
_scored(
    "h64_video",
    "orders",
    "o_orderkey",
    lambda: S.video(_c("o_totalprice"), _c("o_custkey"), _c("o_orderkey % 7"), _c("o_orderkey % 100"), _c("o_custkey * 100"), _day(), _as_of()),
    f"0.3 * least(o_totalprice / 1000000, 1.0) + 0.2 * coalesce(o_custkey / nullif(o_custkey + o_orderkey % 7, 0), 0) + 0.15 * coalesce(least((o_orderkey % 100) / nullif(o_totalprice, 0) * 1000, 1.0), 0) + 0.2 * least(o_custkey * 100 / 1000000, 1.0) + 0.15 * {_fresh(365)}",
)
_scored("h65_pod", "part", "p_partkey", lambda: S.pod(F.lit(0.9), _c("p_size % 12"), _c("CASE p_size % 3 WHEN 0 THEN 'Identity' WHEN 1 THEN 'Unit' ELSE 'Other' END"), _c("p_size % 5")), "0.4 * 0.9 + 0.3 * greatest(0.0, 1 - (p_size % 12) / 10) + 0.2 * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.7 END + 0.1 * least((p_size % 5) / 3, 1.0)")
_scored("h66_dashboard", "orders", "o_orderkey", lambda: S.dashboard(F.lit(0.8), _c("o_orderkey % 15"), _day(), _c("o_custkey % 8"), _as_of()), f"0.4 * 0.8 + 0.3 * least((o_orderkey % 15) / 10, 1.0) + 0.2 * {_fresh(90)} + 0.1 * least((o_custkey % 8) / 5, 1.0)")
_scored("h67_card", "part", "p_partkey", lambda: S.card(F.lit(0.7), _c("CASE p_size % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'map' ELSE 'x' END"), _c("CASE p_size % 2 WHEN 0 THEN 'native' ELSE 'query' END"), _c("p_name")), "0.4 * 0.7 + 0.3 * CASE p_size % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.9 ELSE 0.6 END + 0.2 * CASE p_size % 2 WHEN 0 THEN 1.0 ELSE 0.8 END + 0.1 * least(length(p_name) / 200, 1.0)")
_scored("h68_dataset", "orders", "o_orderkey", lambda: S.dataset(F.lit(0.8), _day(), S.present(_c("o_orderstatus"), _c("o_orderpriority"), _c("nullif(o_orderstatus, 'F')")), _c("o_custkey % 30"), 24, _as_of()), f"0.4 * 0.8 + 0.3 * {_fresh(365)} + 0.2 * ((2 + CAST(o_orderstatus <> 'F' AS INTEGER)) / 3) + 0.1 * least((o_custkey % 30) / 24, 1.0)")
_scored("h69_statistic", "part", "p_partkey", lambda: S.statistic(F.lit(0.9), _c("p_size"), _c("p_size % 40"), _c("CASE p_size % 3 WHEN 0 THEN 'Daily' WHEN 1 THEN 'yearly' ELSE 'x' END")), "0.4 * 0.9 + 0.2 * least(p_size / 20, 1.0) + 0.2 * least((p_size % 40) / 30, 1.0) + 0.2 * CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.5 END")
_scored("h70_contact", "orders", "o_orderkey", lambda: S.contact(F.lit(0.8), _c("CASE o_orderkey % 3 WHEN 0 THEN 'Senior Director' WHEN 1 THEN 'VP Sales' ELSE 'clerk' END"), F.lit(1.0), _day(), _as_of()), f"0.4 * 0.8 + 0.3 * CASE o_orderkey % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.9 ELSE 0.5 END + 0.2 * 1.0 + 0.1 * {_fresh(90)}")
_scored("h71_organisation", "orders", "o_orderkey", lambda: S.organisation(F.lit(1.0), _c("o_custkey % 5 * 300"), _c("o_orderkey % 25"), _day(), _as_of()), f"0.4 * 1.0 + 0.3 * CASE WHEN o_custkey % 5 = 0 THEN 0.5 ELSE least(o_custkey % 5 * 300 / 1000, 1.0) END + 0.2 * least((o_orderkey % 25) / 20, 1.0) + 0.1 * {_fresh(90)}")
_scored("h72_local_firm", "supplier", "s_suppkey", lambda: S.local_firm(F.lit(0.5), _c("CASE s_suppkey % 3 WHEN 0 THEN 'Large' WHEN 1 THEN 'micro' END"), F.lit(0.25), _c("s_suppkey % 7")), "0.4 * 0.5 + 0.3 * CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.4 ELSE 0.5 END + 0.2 * 0.25 + 0.1 * least((s_suppkey % 7) / 5, 1.0)")
_scored("h73_registered_firm", "orders", "o_orderkey", lambda: S.registered_firm(_c("o_orderstatus = 'O'"), F.lit(0.6), _day(), _as_of()), f"0.4 * CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END + 0.4 * 0.6 + 0.2 * {_fresh(365)}")
_scored("h74_documentation", "part", "p_partkey", lambda: S.documentation(F.lit(0.5), _c("p_size / 50.0D"), _c("CASE p_size % 4 WHEN 0 THEN 'latest' WHEN 1 THEN '3.1' WHEN 2 THEN 'beta' ELSE '' END"), _c("p_size % 8")), "0.3 * 0.5 + 0.3 * (p_size / 50) + 0.2 * CASE p_size % 4 WHEN 1 THEN 0.3 WHEN 2 THEN 0.5 ELSE 1.0 END + 0.2 * least((p_size % 8) / 5, 1.0)")
_scored("h75_api_item", "orders", "o_orderkey", lambda: S.api_item(_c("CASE WHEN o_custkey % 2 = 0 THEN 0.9D END"), S.freshness(_day(), _as_of(), 365), _c("o_orderkey % 13")), f"0.4 * CASE WHEN o_custkey % 2 = 0 THEN 0.9 ELSE 0.5 END + 0.3 * {_fresh(365)} + 0.3 * ((o_orderkey % 13) / 10)")
_scored("h76_freshness", "orders", "o_orderkey", lambda: S.freshness(_c("CASE WHEN o_orderkey % 3 > 0 THEN to_date(o_orderdate) END"), _as_of(), 365), f"CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE {_fresh(365)} END")
_scored("h77_capability", "part", "p_partkey", lambda: S.capability([_c("p_size / 50.0D"), _c("p_retailprice / 2000")], [0.6, 0.8], [2.0, 1.0]), "CAST(2.0 / 3 AS DOUBLE) * least(1.0, p_size / 50 / 0.6) + CAST(1.0 / 3 AS DOUBLE) * least(1.0, p_retailprice / 2000 / 0.8)")
_scored("h78_completeness", "customer", "c_custkey", lambda: S.present(_c("c_name"), _c("nullif(c_mktsegment, 'BUILDING')"), _c("CASE WHEN c_acctbal > 0 THEN c_acctbal END")), "(1 + CAST(c_mktsegment <> 'BUILDING' AS INTEGER) + CAST(c_acctbal > 0 AS INTEGER)) / 3")
_scored("h81_image_quality", "part", "p_partkey", lambda: S.image_quality(_c("p_size / 50.0D"), _c("p_retailprice / 2000"), _c("p_size % 10 / 10.0D"), F.lit(1.0)), "greatest(0.0, least(1.0, 0.35 * (p_size / 50) + 0.30 * (p_retailprice / 2000) + 0.20 * (1 - (p_size % 10) / 10) + 0.15 * 1.0))")
_scored("h103_web_hit", "documents", "doc_id", lambda: S.web_hit(_c("doc_id % 4"), _c("doc_id % 2 = 0"), _c("n_chars")), "0.4 * (doc_id % 4) + 0.3 * CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END + 0.3 * (n_chars / 1000)")
_scored("h51_knowledge_match", "part", "p_partkey", lambda: S.knowledge_match(_c("p_size / 50.0D"), _c("p_size % 3 / 2.0D")), "0.7 * (p_size / 50) + 0.3 * ((p_size % 3) / 2)")
_scored("h50_property_bonus", "part", "p_partkey", lambda: S.property_bonus(_c("p_size % 9")), "least(0.2, 0.2 * (p_size % 9) / 6)")


def _labelled(name: str, source: str, key: str, column, sql: str) -> None:
    run = lambda spark, sf: table(spark, sf, source).select(key, column().alias("label"))
    query(name, run, f"SELECT {key}, {sql} AS label FROM {source}")


_labelled("h79_quality_level", "part", "p_partkey", lambda: S.quality_level(_c("p_size / 50.0D"), _c("p_retailprice / 2000"), F.lit(0.5)), "CASE WHEN 0.4 * (p_size / 50) + 0.3 * (p_retailprice / 2000) + 0.15 >= 0.9 THEN 'excellent' WHEN 0.4 * (p_size / 50) + 0.3 * (p_retailprice / 2000) + 0.15 >= 0.75 THEN 'good' WHEN 0.4 * (p_size / 50) + 0.3 * (p_retailprice / 2000) + 0.15 >= 0.6 THEN 'acceptable' WHEN 0.4 * (p_size / 50) + 0.3 * (p_retailprice / 2000) + 0.15 >= 0.4 THEN 'poor' ELSE 'unacceptable' END")
_labelled("h84_human_size", "documents", "doc_id", lambda: S.human_size(_c("n_chars * 100")), "CASE WHEN n_chars * 100 < 1024 THEN CAST(floor(n_chars * 1000.0) / 10 AS VARCHAR) || ' B' WHEN n_chars * 100 < 1048576 THEN CAST(floor(n_chars * 1000.0 / 1024) / 10 AS VARCHAR) || ' KB' WHEN n_chars * 100 < 1073741824 THEN CAST(floor(n_chars * 1000.0 / 1048576) / 10 AS VARCHAR) || ' MB' ELSE CAST(floor(n_chars * 1000.0 / 1073741824) / 10 AS VARCHAR) || ' GB' END")
_labelled("h87_grid_size", "part", "p_partkey", lambda: S.grid_size(_c("p_size * 100"), _c("p_size * 90")), "CASE WHEN p_size * 100 * p_size * 90 <= 1000000 THEN 1 WHEN p_size * 100 * p_size * 90 <= 4000000 THEN 2 WHEN p_size * 100 * p_size * 90 <= 9000000 THEN 3 ELSE 4 END")
_labelled("c23_token_strategy", "documents", "doc_id", lambda: S.token_strategy(_c("n_chars"), 2000), "CASE WHEN n_chars < 1600 THEN 'direct' WHEN n_chars < 3000 THEN 'truncate' WHEN n_chars < 6000 THEN 'sliding_window' ELSE 'summarize' END")
