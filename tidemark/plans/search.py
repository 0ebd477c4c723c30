"""Registered search, ranking and merging queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import search as S
from tidemark.registry import query
from tidemark.session import table

query("c01_search_messages", lambda spark, sf: S.search_messages(table(spark, sf, "conversations"), "tion", "user"), "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'tion') AND role = 'user' ORDER BY conv_id DESC, turn DESC LIMIT 20")
query(
    "c02_search_documents",
    lambda spark, sf: S.top(table(spark, sf, "documents").filter(S.has("source", "src1") | S.has("text", "thing")), 20, F.desc("doc_id")).select("doc_id", "source"),
    "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'thing') ORDER BY doc_id DESC LIMIT 20",
)
query(
    "c03_session_counts",
    lambda spark, sf: S.session_counts(table(spark, sf, "conversations"), "the"),
    "SELECT conv_id, messages FROM (SELECT conv_id, arg_min(text, turn) AS title, count(*) AS messages FROM conversations GROUP BY 1) WHERE contains(lower(title), 'the')",
)
query(
    "c04_dispatched_search",
    lambda spark, sf: S.dispatched({"message": table(spark, sf, "conversations").filter(S.has("text", "thing")).select("conv_id"), "file": table(spark, sf, "documents").filter(S.has("text", "thing")).select("doc_id")}).groupBy("kind").agg(F.count("*").alias("total_count")),
    "SELECT 'message' AS kind, count(*) AS total_count FROM conversations WHERE contains(lower(text), 'thing') UNION ALL SELECT 'file', count(*) FROM documents WHERE contains(lower(text), 'thing')",
)
query("c05_mentions", lambda spark, sf: S.top(table(spark, sf, "customer").filter(S.has("c_name", "01")), 10, F.col("c_custkey")).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '01') ORDER BY c_custkey LIMIT 10")
query("c06_json_field", lambda spark, sf: table(spark, sf, "events").select("event_id", S.nested("props", "k", "").alias("k"), S.nested("props", "missing.path", "").alias("none")), "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.missing.path'), '') AS none FROM events")
query("c07_json_value", lambda spark, sf: table(spark, sf, "events").groupBy(S.nested("props", "k").cast("int").alias("k")).agg(F.count("*").alias("n")), "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
query("c08_mapped_fields", lambda spark, sf: S.mapped(table(spark, sf, "events").select("event_id", "props"), {"title": "k", "snippet": "text"}, "props").drop("props"), "SELECT event_id, substr(coalesce(json_extract_string(props, '$.k'), ''), 1, 200) AS title, '' AS snippet FROM events")
query(
    "c15_cached_results",
    lambda spark, sf: table(spark, sf, "orders").filter((F.col("o_orderdate") > F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority"),
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
query(
    "c16_threads",
    lambda spark, sf: S.threads(table(spark, sf, "conversations")),
    "SELECT r.conv_id, r.role AS root_role, (SELECT count(*) FROM conversations c WHERE c.conv_id = r.conv_id AND c.turn = 1) AS replies FROM conversations r WHERE turn = 0",
)
query("g04_distinct_content", lambda spark, sf: S.distinct_content(table(spark, sf, "documents"), "doc_id", "text"), "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
query("g06_distinct_link", lambda spark, sf: S.distinct_link(table(spark, sf, "pages"), "page_id", "url"), "SELECT url, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY 1")


def _ranked_lists(spark, sf):
    """The twenty longest documents of each language and of each source, as ranked lists."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lists = []
    for by in ("lang", "source"):
        w = Window.partitionBy(by).orderBy(F.desc("n_chars"), "doc_id")
        lists.append(docs.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("doc_id", "rank"))
    return lists[0].unionByName(lists[1])


_lists = "(SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) FROM documents)"
query("e04_rank_fusion", lambda spark, sf: S.rank_fusion(_ranked_lists(spark, sf), "doc_id"), f"SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS lists FROM {_lists} WHERE rank <= 20 GROUP BY 1")
query(
    "e04_similarity_fusion",
    lambda spark, sf: S.similarity_fusion(table(spark, sf, "lineitem").select("l_partkey", F.col("l_discount").alias("s")), "l_partkey", "s"),
    "SELECT l_partkey, round(max(1.0 / (60 + greatest(1, floor((1 - l_discount) * 10)))), 9) AS score FROM lineitem GROUP BY 1",
)


def _graph_and_vectors(spark, sf):
    graph = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 0.5 + F.col("toxic") * 0.25).alias("score"))
    w = Window.orderBy(F.desc("n_chars"), "doc_id")  # a list of fifty
    top = table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return graph, top.select("doc_id", (F.row_number().over(w) - 1).alias("i"), F.lit(50).alias("n"))


_vec = "(SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i, 50 AS n FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)"
query(
    "d15_merged_scores",
    lambda spark, sf: S.merged_scores(*_graph_and_vectors(spark, sf), "doc_id"),
    f"SELECT doc_id, round(coalesce(g * 0.7::DOUBLE, 0) + coalesce((1 - i / n) * 0.3::DOUBLE, 0), 6) AS score FROM (SELECT doc_id, max(quality * 0.5::DOUBLE + toxic * 0.25::DOUBLE) AS g FROM labels GROUP BY 1) FULL JOIN {_vec} USING (doc_id)",
)


def _two_lists(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    longest = docs.orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id", (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("rank"))
    first = docs.filter("n_chars > 3000").orderBy("doc_id").limit(15).select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).alias("rank"))
    return longest, first


query(
    "d16_hybrid_search",
    lambda spark, sf: S.hybrid(*_two_lists(spark, sf), "doc_id"),
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS v FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS g FROM documents WHERE n_chars > 3000 ORDER BY doc_id LIMIT 15)
    SELECT doc_id, round(0.7::DOUBLE * coalesce(greatest(0.0, (10 - v) / 10), 0) + 0.3::DOUBLE * coalesce(greatest(0.0, (10 - g) / 10), 0), 6) AS score FROM a FULL JOIN b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10""",
)


def _metrics(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_extendedprice").alias("time_ms"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("quality"), F.col("l_tax").alias("run_cost"))


query(
    "e01_metric_ranks",
    lambda spark, sf: S.unpivoted_ranks(_metrics(spark, sf), "model", ["time_ms", "quality", "run_cost"]),
    """WITH l AS (SELECT l_suppkey AS model, unnest(['time_ms', 'quality', 'run_cost']) AS metric, unnest([l_extendedprice, CASE WHEN l_discount > 0.02 THEN l_discount END, l_tax]) AS x FROM lineitem),
    s AS (SELECT metric, model, round(sum(coalesce(x, 0)) / count(*), 6) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS std, round(avg(x), 6) AS avg_present FROM l GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric LIKE '%\\_ms' ESCAPE '\\' OR metric LIKE '%\\_cost' ESCAPE '\\' THEN mean ELSE -mean END, model) AS INTEGER) AS rank FROM s""",
)
query(
    "d25_previous_run",
    lambda spark, sf: S.previous_run(table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))),
    "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1), b AS (SELECT *, lag(mean) OVER (ORDER BY run) AS baseline FROM m) SELECT run, mean, baseline, round(100.0 * (mean - baseline) / nullif(baseline, 0), 4) AS change_pct FROM b",
)
query(
    "f05_models_per_provider",
    lambda spark, sf: table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("models"), F.countDistinct("p_type").alias("types")),
    "SELECT p_brand, count(*) AS models, count(DISTINCT p_type) AS types FROM part GROUP BY 1",
)
query(
    "f15_model_stats",
    lambda spark, sf: table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("runs"), F.round(F.avg("l_quantity"), 6).alias("avg_duration"), F.round(F.sum("l_quantity"), 2).alias("total_duration"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_tax"))), 6).alias("gpu_avg")),
    "SELECT l_suppkey, count(*) AS runs, round(avg(l_quantity), 6) AS avg_duration, round(sum(l_quantity), 2) AS total_duration, round(avg(CASE WHEN l_discount > 0.05 THEN l_tax END), 6) AS gpu_avg FROM lineitem GROUP BY 1",
)
query(
    "f16_rollup",
    lambda spark, sf: table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("runs"), F.round(F.avg("l_quantity"), 6).alias("avg_duration")).select(F.coalesce("l_returnflag", F.lit("overall")).alias("model"), "runs", "avg_duration"),
    "SELECT coalesce(l_returnflag, 'overall') AS model, count(*) AS runs, round(avg(l_quantity), 6) AS avg_duration FROM lineitem GROUP BY ROLLUP (l_returnflag)",
)
query(
    "f29_provider_means",
    lambda spark, sf: table(spark, sf, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("provider")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean")),
    "SELECT split_part(p_type, ' ', 1) AS provider, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1",
)
query(
    "f30_strategy_stats",
    lambda spark, sf: table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(F.avg("l_tax"), 6).alias("mean"), F.min("l_tax").alias("min"), F.max("l_tax").alias("max"), F.round(F.stddev_pop("l_tax"), 6).alias("std"), F.count("*").alias("count")),
    "SELECT l_linestatus, round(avg(l_tax), 6) AS mean, min(l_tax) AS min, max(l_tax) AS max, round(stddev_pop(l_tax), 6) AS std, count(*) AS count FROM lineitem GROUP BY 1",
)


def _best_strategy(spark, sf):
    means = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("mean"), "l_linestatus")
    return means.withColumn("r", F.row_number().over(w)).select("l_returnflag", "l_linestatus", "mean", "n", (F.col("r") == 1).alias("best"))


query(
    "f31_f32_strategy_by_type",
    _best_strategy,
    "WITH m AS (SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY mean DESC, l_linestatus) = 1 AS best FROM m",
)
query(
    "f33_confidence_correlation",
    lambda spark, sf: table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r")).filter("n > 5"),
    "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1 HAVING count(*) > 5",
)
query(
    "f34_strategy_weights",
    lambda spark, sf: table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.avg("l_discount").alias("q")).select("l_linestatus", F.round(F.col("q") / F.sum("q").over(Window.partitionBy()), 6).alias("weight")),
    "SELECT l_linestatus, round(avg(l_discount) / sum(avg(l_discount)) OVER (), 6) AS weight FROM lineitem GROUP BY 1",
)
query(
    "e02_best_and_worst_task",
    lambda spark, sf: table(spark, sf, "lineitem")
    .groupBy("l_suppkey", "l_linenumber")
    .agg(F.round(F.avg(300 / F.greatest(F.lit(1.0), F.col("l_extendedprice")) + 0.7 * F.col("l_discount")), 9).alias("s"))
    .groupBy("l_suppkey")
    .agg(F.max_by("l_linenumber", F.struct("s", -F.col("l_linenumber"))).alias("best_task"), F.min_by("l_linenumber", F.struct("s", "l_linenumber")).alias("worst_task")),
    """WITH s AS (SELECT l_suppkey, l_linenumber, round(avg(300 / greatest(1.0, l_extendedprice) + 0.7::DOUBLE * l_discount), 9) AS s FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_linenumber) AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, l_linenumber) AS w FROM s)
    SELECT l_suppkey, max(CASE WHEN b = 1 THEN l_linenumber END) AS best_task, max(CASE WHEN w = 1 THEN l_linenumber END) AS worst_task FROM r GROUP BY 1""",
)
# Costs. Watts of ten models, idle and under load; rates of 26 cantons, .24 elsewhere.
POWER = {
    "RTX 3090": (30, 350),
    "RTX 3080": (25, 320),
    "RTX 3070": (20, 220),
    "RTX 3060": (15, 170),
    "RTX 2080 Ti": (20, 280),
    "RTX 2080": (18, 225),
    "GTX 1080 Ti": (15, 250),
    "GTX 1080": (12, 180),
    "T4": (8, 70),
    "A100": (40, 400),
}
RATES = {
    "ZH": 0.2547, "BE": 0.2312, "LU": 0.2219, "UR": 0.1998, "SZ": 0.2076, "OW": 0.2115, "NW": 0.2087, "GL": 0.2265, "ZG": 0.1847, "FR": 0.2108, "SO": 0.2298, "BS": 0.2387, "BL": 0.2312,
    "SH": 0.2454, "AR": 0.2287, "AI": 0.2189, "SG": 0.2356, "GR": 0.2245, "AG": 0.2267, "TG": 0.2198, "TI": 0.2376, "VD": 0.2298, "VS": 0.2098, "NE": 0.2387, "GE": 0.2543, "JU": 0.2265,
}
_MODELS, _CANTONS = "[" + ", ".join(map(repr, POWER)) + "]", "[" + ", ".join(map(repr, RATES)) + "]"


def _energy(spark, sf):
    """A run of l_quantity seconds on one of ten models, at a load of ten times the discount."""
    run = table(spark, sf, "lineitem").withColumn("model", F.get(F.array(*map(F.lit, POWER)), (F.col("l_partkey") % len(POWER)).cast("int")))
    idle, load = (F.create_map(*[F.lit(x) for k, v in POWER.items() for x in (k, float(v[i]))])[F.col("model")] for i in (0, 1))
    run = run.withColumn("kwh", (idle + (load - idle) * F.col("l_discount") * 10) * F.col("l_quantity") / 3600 / 1000)
    return run.select("l_orderkey", "l_linenumber", "model", F.round("kwh", 9).alias("kwh"), F.round(F.col("kwh") * 0.24, 9).alias("cost"), F.round(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)), 9).alias("tokens_per_second"))


query(
    "h57_energy_cost",
    _energy,
    f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v[0]}.0::DOUBLE, {v[1]}.0::DOUBLE)" for k, v in POWER.items())}) t(model, idle, load)),
    r AS (SELECT *, ({_MODELS})[l_partkey % {len(POWER)} + 1] AS model FROM lineitem), e AS (SELECT r.*, (idle + (load - idle) * l_discount * 10) * l_quantity / 3600 / 1000 AS kwh FROM r JOIN p USING (model))
    SELECT l_orderkey, l_linenumber, model, round(kwh, 9) AS kwh, round(kwh * 0.24::DOUBLE, 9) AS cost, round(l_extendedprice / nullif(l_quantity, 0), 9) AS tokens_per_second FROM e""",
)
CLOUD = {"a": 0.002, "b": 0.06, "c": 0.0025, "d": 0.03}  # fixed values: prices of a thousand tokens at four providers
query(
    "h58_cost_forecast",
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", *[F.round(F.col("p_retailprice") * 0.001 * d, 6).alias(f"cost_{d}") for d in (1, 30, 365)], *[F.round(F.col("p_size") * p - F.col("p_retailprice") * 0.001, 6).alias(f"saving_{k}") for k, p in CLOUD.items()]),
    "SELECT p_partkey, " + ", ".join(f"round(p_retailprice * 0.001::DOUBLE * {d}, 6) AS cost_{d}" for d in (1, 30, 365)) + ", " + ", ".join(f"round(p_size * {p}::DOUBLE - p_retailprice * 0.001::DOUBLE, 6) AS saving_{k}" for k, p in CLOUD.items()) + " FROM part",
)


def regional_rate(canton):
    """The canton's rate, the mean rate for any other."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv]), canton), F.lit(0.24))


query(
    "h60_regional_rate",
    lambda spark, sf: table(spark, sf, "customer").withColumn("canton", F.get(F.array(*map(F.lit, RATES)), (F.col("c_custkey") % 28).cast("int"))).select("c_custkey", "canton", regional_rate(F.coalesce("canton", F.lit("?"))).alias("rate")),
    f"WITH c AS (SELECT c_custkey, ({_CANTONS})[c_custkey % 28 + 1] AS canton FROM customer) SELECT c_custkey, c.canton, coalesce(r, 0.24::DOUBLE) AS rate FROM c LEFT JOIN (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in RATES.items())}) v(canton, r) ON c.canton = v.canton",
)
