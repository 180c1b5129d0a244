"""The registry of queries: each is a function of (spark, folder of tables), with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.apps import traffic, wordcount
from weftline.functions import geo
from weftline.functions.text import space_tokens
from weftline.operators import arrays, iterate, loops, nodes, routing, stencil
from weftline.operators.tasks import AsyncKernel, TaskGraph, run_tasks
from weftline.plans.graph import AllToAll, Farm, Pipeline, Stage, kernel
from weftline.plans.lower import run
from weftline.plans.rewrite import optimise
from weftline.sources.readers import count_sink, generate, invoke, records, replay, replay_for, road_segments, table
from weftline.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


LINES = "lines AS (SELECT doc_id, t.line - 1 AS line, t.text_line FROM documents, UNNEST(string_split(text, chr(10))) WITH ORDINALITY AS t(text_line, line) WHERE t.text_line <> '')"
TOKENS = f"{LINES}, tokens AS (SELECT doc_id, line, t.pos - 1 AS pos, substring(t.word, 1, 31) AS word FROM lines, UNNEST(list_filter(string_split(text_line, ' '), lambda w: w <> '')) WITH ORDINALITY AS t(word, pos))"


# --- word count


@query("q01_wordcount", f"WITH {TOKENS} SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM tokens GROUP BY word")
def q01(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.totals(table(spark, d, "documents"))


@query("q02_wordcount_running", f"WITH {TOKENS} SELECT doc_id, CAST(line AS INT) AS line, CAST(pos AS INT) AS pos, word, CAST(row_number() OVER (PARTITION BY word ORDER BY doc_id, line, pos) AS BIGINT) AS id FROM tokens")
def q02(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.running(table(spark, d, "documents"))


@query("q03_wordcount_totals", f'WITH {TOKENS} SELECT CAST((SELECT count(*) FROM tokens) AS BIGINT) AS words, CAST((SELECT count(DISTINCT word) FROM tokens) AS BIGINT) AS "unique", CAST((SELECT count(*) FROM lines) AS BIGINT) AS total_lines, CAST((SELECT 152 * count(*) FROM lines) AS BIGINT) AS total_bytes')
def q03(spark: SparkSession, d: str) -> DataFrame:
    return wordcount.summary(table(spark, d, "documents"))


@query("q70_wordcount_stamped", f"WITH {TOKENS}, s AS (SELECT doc_id AS d, max(n_chars) AS ts FROM documents GROUP BY doc_id) SELECT word, CAST(id AS BIGINT) AS id, CAST(ts AS BIGINT) AS ts FROM (SELECT word, row_number() OVER (PARTITION BY word ORDER BY doc_id, line, pos) AS id, ts FROM tokens JOIN s ON d = doc_id) WHERE id <= 3")
def q70(spark: SparkSession, d: str) -> DataFrame:
    """The first three occurrences of each word with the stamp that its line carries (the length of its document)."""
    docs = table(spark, d, "documents").withColumn("ts", F.col("n_chars").cast("long"))
    return wordcount.running(docs, carry=("ts",)).where("id <= 3").select("word", "id", "ts")


# --- sources and single items


@query("q04_parse_records", "SELECT event_id, CAST(user_id AS INT) AS n_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS speed, CAST(0 AS INT) AS direction FROM events WHERE event_id % 7 <> 3")
def q04(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    number = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    line = F.when(F.col("event_id") % 7 == 3, F.concat_ws(",", "event_type", "user_id")).otherwise(F.concat_ws(",", "event_type", "user_id", number, F.lit("east")))
    return records(e.select("event_id", line.alias("line")), "line", [(1, "n_id", "int"), (2, "speed", "double"), (3, "direction", "int")], 4)


@query("q05_map", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT) AS net FROM lineitem")
def q05(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    out = nodes.map_items(table(spark, d, "lineitem"), cents=cents, net=cents * F.round((1 - F.col("l_discount")) * 100).cast("bigint"))
    return nodes.project(out, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "net")


@query("q06_filter", "SELECT event_id, user_id, value FROM events WHERE value BETWEEN 50 AND 250 AND user_id BETWEEN 10 AND 90")
def q06(spark: SparkSession, d: str) -> DataFrame:
    return nodes.filter_items(table(spark, d, "events").select("event_id", "user_id", "value"), "value BETWEEN 50 AND 250 AND user_id BETWEEN 10 AND 90")


@query("q07_flatmap", "SELECT event_id, CAST(t.item AS BIGINT) AS item FROM events, UNNEST(range(event_id, event_id + event_id % 4)) AS t(item)")
def q07(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    items = F.when(k > 0, F.sequence(F.col("event_id"), F.col("event_id") + k - 1))
    return nodes.flat_map(table(spark, d, "events").select("event_id"), items)


@query("q08_take_while", "WITH stops AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT e.event_id, e.user_id, e.event_type FROM events e LEFT JOIN stops s USING (user_id) WHERE s.stop IS NULL OR e.event_id < s.stop")
def q08(spark: SparkSession, d: str) -> DataFrame:
    return nodes.take_while(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_type = 'error'", "event_id", "user_id")


@query("q09_selector", "SELECT event_id, CASE event_type WHEN 'purchase' THEN CAST(round(value * 100) AS BIGINT) WHEN 'error' THEN CAST(-1 AS BIGINT) WHEN 'view' THEN user_id ELSE CAST(0 AS BIGINT) END AS result FROM events")
def q09(spark: SparkSession, d: str) -> DataFrame:
    kernels = {"purchase": F.round(F.col("value") * 100).cast("bigint"), "error": F.lit(-1).cast("bigint"), "view": F.col("user_id"), "none": F.lit(0).cast("bigint")}
    return table(spark, d, "events").select("event_id", nodes.select_node("event_type", kernels, "none").alias("result"))


@query("q10_gen", "SELECT CAST(i AS BIGINT) AS i, CAST(i * i AS BIGINT) AS item FROM range(5, 1000, 3) AS t(i)")
def q10(spark: SparkSession, d: str) -> DataFrame:
    return generate(spark, 5, lambda i: i < 1000, 3).select("i", (F.col("i") * F.col("i")).alias("item"))


@query("q53_replay", "SELECT CAST(g AS INT) AS generation, CAST(count(*) AS BIGINT) AS items FROM nation, range(3) AS t(g) GROUP BY g")
def q53(spark: SparkSession, d: str) -> DataFrame:
    return count_sink(replay(table(spark, d, "nation"), 3).groupBy("generation"))


@query("q58_replay_for", "SELECT CAST(1 AS INT) AS passes, CAST(count(*) AS BIGINT) AS items FROM nation")
def q58(spark: SparkSession, d: str) -> DataFrame:
    """A time limit that is over at once: one whole pass."""
    passes, items = replay_for(table(spark, d, "nation"), lambda df, k: df.write.format("noop").mode("overwrite").save(), 0.0)
    return spark.range(1).select(F.lit(passes).cast("int").alias("passes"), F.lit(items).cast("long").alias("items"))


@query("q59_no_input", "SELECT CAST(s AS BIGINT) AS source, CAST(count(*) AS BIGINT) AS items, CAST(sum(k * k) AS BIGINT) AS total FROM range(4) AS a(s), range(100) AS b(k) WHERE k < 10 * (s + 1) GROUP BY s")
def q59(spark: SparkSession, d: str) -> DataFrame:
    made = invoke(spark, lambda source, k: (source, k * k) if k < 10 * (source + 1) else None, "source long, item long", sources=4)
    return made.groupBy("source").agg(F.count("*").alias("items"), F.sum("item").alias("total"))


@query("q60_bus_tuples", "SELECT CAST(user_id AS BIGINT) AS key, event_id AS \"order\", CAST(event_id % 90 AS DOUBLE) AS latitude, CAST(event_id % 180 AS DOUBLE) AS longitude, CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS speed FROM events")
def q60(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type", "value", (F.col("event_id") % 180).alias("x"), (F.col("event_id") % 90).alias("y"))
    bus = traffic.tuples(e.where("event_type = 'view'"), "user_id", "event_id", "x", "y", None)
    return bus.unionByName(traffic.tuples(e.where("event_type <> 'view'"), "user_id", "event_id", "x", "y", "value"))


@query("q61_kernel_measures", "SELECT CASE WHEN event_type IN ('purchase', 'error') THEN event_type ELSE 'none' END AS command, CAST(count(*) AS BIGINT) AS items FROM events GROUP BY 1")
def q61(spark: SparkSession, d: str) -> DataFrame:
    return nodes.kernel_measures(table(spark, d, "events"), "event_type", {"purchase": F.lit(1), "error": F.lit(2), "none": F.lit(0)}, "none")


# --- routing and gathering


@query("q62_manager", "SELECT event_id, CAST(control AS BIGINT) AS control FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN user_id END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS control FROM events) WHERE event_type <> 'error'")
def q62(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("long").alias("user_id"))
    return routing.managed(e.where("event_type <> 'error'").select("event_id"), e.where("event_type = 'error'"), "event_id", "user_id")


@query("q11_route_rr", "SELECT CAST(event_id % 7 AS INT) AS worker, CAST(count(*) AS BIGINT) AS items, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY 1")
def q11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(routing.round_robin("event_id", 7).alias("worker")).agg(F.count("*").alias("items"), F.sum("event_id").alias("total"))


@query("q12_route_key", "SELECT CAST(user_id % 4 AS INT) AS worker, user_id, CAST(count(*) AS BIGINT) AS items FROM events GROUP BY 1, 2")
def q12(spark: SparkSession, d: str) -> DataFrame:
    graph = Pipeline((Stage(lambda x: x.select("user_id"), multi_out=True), AllToAll(Stage(lambda x: x), 2, Stage(lambda x: x.groupBy("worker", "user_id").agg(F.count("*").alias("items"))), 4, routing.by_number("user_id", 4))))
    return run(graph, table(spark, d, "events"))


@query("q13_broadcast", "SELECT n_nationkey, n_name, CAST(w AS INT) AS worker FROM nation, range(3) AS t(w)")
def q13(spark: SparkSession, d: str) -> DataFrame:
    return routing.broadcast_items(table(spark, d, "nation").select("n_nationkey", "n_name"), 3)


@query("q14_misd", "SELECT event_id, value_id, CAST(CASE WHEN value_id % 2 = 0 THEN place % 2 ELSE 2 + place % 3 END AS INT) AS worker FROM (SELECT event_id, user_id AS value_id, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS place FROM events)")
def q14(spark: SparkSession, d: str) -> DataFrame:
    return routing.even_odd(table(spark, d, "events").select("event_id", F.col("user_id").alias("value_id")), "value_id", "event_id", 2, 3)


@query("q15_ordered_farm", "SELECT event_id AS seq, value * 2 AS doubled FROM events WHERE event_id % 10 <> 9 ORDER BY 1")
def q15(spark: SparkSession, d: str) -> DataFrame:
    worker = Stage(lambda x: x.where(F.col("seq") % 10 != 9).select("seq", (F.col("value") * 2).alias("doubled")))
    return run(Farm(worker, 3, ordered=True), table(spark, d, "events").select(F.col("event_id").alias("seq"), "value"))


@query("q16_scatter", "SELECT i AS idx, CAST(i // 12 AS INT) AS \"right\", CAST(CASE WHEN i // 12 < 6 THEN (i // 12) // 3 ELSE 2 + (i // 12 - 6) // 2 END AS INT) AS \"left\" FROM range(96) AS t(i)")
def q16(spark: SparkSession, d: str) -> DataFrame:
    return routing.scatter(spark.range(96).select(F.col("id").alias("idx")), "idx", 96, 3, 8)


@query("q17_gather_any", "SELECT n_nationkey AS key, CAST(0 AS INT) AS channel FROM nation UNION ALL SELECT r_regionkey, CAST(1 AS INT) FROM region UNION ALL SELECT CAST(s_suppkey AS INT), CAST(2 AS INT) FROM supplier")
def q17(spark: SparkSession, d: str) -> DataFrame:
    return routing.gather_any([table(spark, d, t).select(F.col(c).cast("int").alias("key")) for t, c in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"))])


@query("q18_all_gather", "WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq FROM events WHERE event_type IN ('view', 'click', 'error')) SELECT CAST(seq AS BIGINT) AS seq, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b, max(value) FILTER (event_type = 'error') AS c, CAST(count(*) AS INT) AS live FROM p GROUP BY seq")
def q18(spark: SparkSession, d: str) -> DataFrame:
    channel = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 2)
    e = table(spark, d, "events").withColumn("channel", channel).where(F.col("channel").isNotNull())
    out = routing.gather_all(e, "channel", "event_id", "value", 3)
    return out.select("seq", *[F.col("items")[k].alias(c) for k, c in enumerate("abc")], "live")


@query("q66_route_hash", "SELECT event_type, CAST(1 AS BIGINT) AS workers, CAST(count(*) AS BIGINT) AS items FROM events GROUP BY event_type")
def q66(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are no numbers: each key's items meet at one worker."""
    e = routing.route(table(spark, d, "events").select("event_type"), routing.by_key("event_type", 6), 6)
    return e.groupBy("event_type").agg(F.count_distinct("worker").alias("workers"), F.count("*").alias("items"))


@query("q67_multicast", "SELECT CAST(w AS INT) AS worker, CAST(count(*) AS BIGINT) AS items, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT event_id, unnest([user_id % 2, 2 + user_id % 3]) AS w FROM events) GROUP BY w")
def q67(spark: SparkSession, d: str) -> DataFrame:
    e = routing.multicast(table(spark, d, "events").select("event_id", "user_id"), F.array((F.col("user_id") % 2).cast("int"), (2 + F.col("user_id") % 3).cast("int")))
    return e.groupBy("worker").agg(F.count("*").alias("items"), F.sum("event_id").alias("total"))


@query("q69_kernel_forms", "SELECT f AS form, CAST(count(*) AS BIGINT) AS items, CAST(sum(2 * user_id + 1) AS BIGINT) AS total FROM events, (VALUES ('pipe'), ('farm'), ('ordered')) AS t(f) GROUP BY f")
def q69(spark: SparkSession, d: str) -> DataFrame:
    """One kernel in three forms, started without waiting for each other."""
    stages = (Stage(lambda x: x.withColumn("v", 2 * F.col("user_id"))), Stage(lambda x: x.withColumn("v", F.col("v") + 1)))
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id")
    with AsyncKernel(lambda form: run(kernel(form, *stages, workers=3), e).agg(F.count("*").alias("items"), F.sum("v").alias("total")).first()) as k:
        started = {form: k.submit(form) for form in ("pipe", "farm", "ordered")}
        made = [(form, f.result()["items"], f.result()["total"]) for form, f in started.items()]
    return spark.createDataFrame(made, "form string, items long, total long")


@query("q54_farm_rewrite", "SELECT event_id, user_id + 1 AS a, (user_id + 1) * 3 AS b FROM events WHERE user_id % 2 = 0")
def q54(spark: SparkSession, d: str) -> DataFrame:
    graph = Pipeline((Farm(Stage(lambda x: x.select("event_id", "user_id")), 4), Farm(Stage(lambda x: x.where("user_id % 2 = 0").withColumn("a", F.col("user_id") + 1)), 4), Farm(Stage(lambda x: x.select("event_id", "a", (F.col("a") * 3).alias("b"))), 2)))
    return run(optimise(graph), table(spark, d, "events"))


# --- loops and reductions


@query("q19_for_step", "SELECT 'up' AS kind, CAST(i AS BIGINT) AS idx FROM range(3, 1000, 7) AS t(i) UNION ALL SELECT 'down', CAST(50 - 4 * i AS BIGINT) FROM range(13) AS t(i)")
def q19(spark: SparkSession, d: str) -> DataFrame:
    up, down = loops.indices(spark, 3, 1000, 7), loops.indices(spark, 50, 0, -4, grain=4)
    return up.select(F.lit("up").alias("kind"), "idx").union(down.select(F.lit("down"), "idx"))


@query("q20_static_blocks", "SELECT i AS k, CAST(CASE WHEN i < 3 * 15 THEN i // 15 ELSE 3 + (i - 45) // 14 END AS INT) AS worker FROM range(101) AS t(i)")
def q20(spark: SparkSession, d: str) -> DataFrame:
    return loops.indices(spark, 0, 101).select("k", loops.static_worker("k", 101, 7).alias("worker"))


@query("q21_static_grain", "SELECT i AS k, CAST((i // 8) % 3 AS INT) AS worker FROM range(1000) AS t(i)")
def q21(spark: SparkSession, d: str) -> DataFrame:
    return loops.indices(spark, 0, 1000).select("k", loops.static_worker("k", 1000, 3, grain=8).alias("worker"))


@query("q22_for_idx", "SELECT CAST(event_id // 64 AS BIGINT) AS part, CAST(sum(user_id) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS items FROM events GROUP BY 1")
def q22(spark: SparkSession, d: str) -> DataFrame:
    return loops.partials(table(spark, d, "events"), loops.chunk_of("event_id", 64), total=F.sum("user_id"), items=F.count("*"))


@query("q23_reduce_init", "SELECT CAST(1000 + sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events")
def q23(spark: SparkSession, d: str) -> DataFrame:
    return loops.reduce_all(table(spark, d, "events"), total=("+", "cast(round(value * 100) as bigint)", 1000))


@query("q24_multireduce", "SELECT CAST(1000 + sum(c) AS BIGINT) AS total, CAST(-1000 - sum(c) AS BIGINT) AS diff FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)")
def q24(spark: SparkSession, d: str) -> DataFrame:
    return loops.reduce_all(table(spark, d, "lineitem"), total=("+", "cast(round(l_extendedprice * 100) as bigint)", 1000), diff=("+", "-cast(round(l_extendedprice * 100) as bigint)", -1000))


@query("q25_reduce_ops", "SELECT CAST(sum(p_size) AS BIGINT) AS total, min(p_size) AS low, max(p_size) AS high, CAST(bit_and(p_size) AS INT) AS ands, CAST(bit_or(p_size) AS INT) AS ors, CAST(bit_xor(p_size) AS INT) AS xors, (SELECT CAST(product(n_regionkey + 1) AS DOUBLE) FROM nation WHERE n_nationkey < 12) AS prod FROM part")
def q25(spark: SparkSession, d: str) -> DataFrame:
    ints = loops.reduce_all(table(spark, d, "part"), total=("+", "p_size", 0), low=("min", "p_size", 2**31 - 1), high=("max", "p_size", -(2**31)), ands=("&", "p_size", -1), ors=("|", "p_size", 0), xors=("^", "p_size", 0))
    prod = loops.reduce_all(table(spark, d, "nation").where("n_nationkey < 12"), prod=("*", "n_regionkey + 1", 1.0))
    return ints.crossJoin(F.broadcast(prod))


@query("q26_dot", "SELECT CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT) * c) AS BIGINT) AS dot FROM part JOIN (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS c FROM part) ON p_partkey = k")
def q26(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("a"), F.col("p_size").cast("bigint").alias("b"))
    return loops.dot(p.select("k", "a"), p.select("k", "b"), "k", "a", "b")


@query("q27_pipe_reduce", "SELECT (event_id * event_id + 2 * event_id + 1) % 997 AS slot, arg_max(user_id, event_id) AS value FROM events GROUP BY 1")
def q27(spark: SparkSession, d: str) -> DataFrame:
    return loops.last_writer(table(spark, d, "events"), "(event_id * event_id + 2 * event_id + 1) % 997", "user_id", "event_id")


@query("q28_array_map", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 5) AS ends FROM embeddings")
def q28(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("v", arrays.map_array("embedding", lambda x: x.cast("double")))
    squares = arrays.map_arrays("v", "v", lambda a, b: a * b)
    mirror = arrays.map_arrays("v", F.reverse("v"), lambda a, b: a + b)
    return e.select("vec_id", F.round(arrays.reduce_array(squares, F.lit(0.0), lambda a, b: a + b), 4).alias("norm2"), F.round(mirror[0], 5).alias("ends"))


@query("q29_distinct_keys", "SELECT CAST(user_id % 3 AS INT) AS worker, CAST(count(DISTINCT user_id) AS BIGINT) AS keys FROM events GROUP BY 1 UNION ALL SELECT NULL, CAST(count(DISTINCT user_id) AS BIGINT) FROM events")
def q29(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id").distinct()
    each = e.groupBy(routing.by_number("user_id", 3).alias("worker")).agg(F.count("*").alias("keys"))
    return each.unionByName(each.agg(F.sum("keys").alias("keys")).withColumn("worker", F.lit(None).cast("int")))


@query("q30_env_map", "SELECT c_custkey, n_name, CAST(round(c_acctbal * 100) AS BIGINT) * (n_regionkey + 1) AS scaled FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def q30(spark: SparkSession, d: str) -> DataFrame:
    out = arrays.with_environment(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey")
    return out.select("c_custkey", "n_name", (F.round(F.col("c_acctbal") * 100).cast("bigint") * (F.col("n_regionkey") + 1)).alias("scaled"))


@query("q63_thid", "SELECT CAST(count(*) AS BIGINT) AS items, CAST(sum(user_id) AS BIGINT) AS total FROM events")
def q63(spark: SparkSession, d: str) -> DataFrame:
    each = loops.with_thread(table(spark, d, "events").select("user_id")).groupBy("_thid").agg(F.count("*").alias("items"), F.sum("user_id").alias("total"))
    return each.agg(F.sum("items").alias("items"), F.sum("total").alias("total"))


@query("q64_udaf", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum((user_id * user_id) % 101) AS BIGINT) AS total, CAST(max(event_id) AS BIGINT) AS top FROM events WHERE user_id % 2 = 1")
def q64(spark: SparkSession, d: str) -> DataFrame:
    """A body over batches of items, its identity, and what joins partial results."""

    def body(state: tuple, b) -> tuple:
        odd = b[b["user_id"] % 2 == 1]
        return state[0] + len(odd), state[1] + int(((odd["user_id"] ** 2) % 101).sum()), max([state[2], *odd["event_id"].tolist()])

    final = lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2]))
    return loops.fold_with(table(spark, d, "events").select("event_id", "user_id"), body, (0, 0, -1), final, "n long, total long, top long")


# --- task graphs


def _four_arrays() -> TaskGraph:
    """Eight tasks over four arrays, which end in one number."""
    plus = lambda x, *ys: _add(x, *ys)
    g = TaskGraph()
    g.add("t1", plus, ("A", "B"), ("A",)).add("t2", plus, ("C", "B"), ("C",)).add("t3", plus, ("D", "B"), ("D",))
    g.add("t4", plus, ("D", "A", "C"), ("D",)).add("t5", plus, ("A", "D"), ("A",)).add("t6", plus, ("B", "C"), ("B",)).add("t7", plus, ("C", "A", "B"), ("C",))
    return g.add("t8", lambda a, b, c, e: _add(a, b, c, e).agg(F.sum("v").alias("total")), ("A", "B", "C", "D"), ("R",))


def _add(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for k, o in enumerate(others):
        out = out.join(o.withColumnRenamed("v", f"_v{k}"), "i").withColumn("v", F.col("v") + F.col(f"_v{k}")).drop(f"_v{k}")
    return out


_N = 1 << 16
_INPUTS = {"A": "cast(0 as bigint)", "B": "id", "C": "cast(1 as bigint)", "D": "id + 1"}


@query("q31_mdf", f"WITH x AS (SELECT CAST(i AS BIGINT) AS i FROM range({_N}) AS t(i)), s AS (SELECT i AS a, i AS b, 1 + i AS c, 2 * i + 1 AS d FROM x), s4 AS (SELECT a, b, c, d + a + c AS d FROM s), s6 AS (SELECT a + d AS a, b + c AS b, c, d FROM s4) SELECT CAST(sum(a + b + (c + a + b) + d) AS BIGINT) AS total FROM s6")
def q31(spark: SparkSession, d: str) -> DataFrame:
    inputs = {k: spark.range(_N).select(F.col("id").alias("i"), F.expr(v).alias("v")) for k, v in _INPUTS.items()}
    return _four_arrays().run(inputs)["R"]


@query("q32_taskf", "SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS items FROM customer UNION ALL SELECT 'nation', CAST(count(*) AS BIGINT) FROM nation UNION ALL SELECT 'part', CAST(count(*) AS BIGINT) FROM part UNION ALL SELECT 'region', CAST(count(*) AS BIGINT) FROM region")
def q32(spark: SparkSession, d: str) -> DataFrame:
    names = ["customer", "nation", "part", "region"]
    counts = run_tasks([lambda n=n: table(spark, d, n).count() for n in names])
    return spark.createDataFrame(list(zip(names, counts, strict=True)), "name string, items long")


_DEPS = [("t1", "t4", "A", "RAW"), ("t1", "t5", "A", "RAW"), ("t2", "t4", "C", "RAW"), ("t2", "t6", "C", "RAW"), ("t2", "t7", "C", "RAW"), ("t3", "t4", "D", "RAW"), ("t4", "t5", "A", "WAR"), ("t4", "t5", "D", "RAW"), ("t1", "t6", "B", "WAR"), ("t2", "t6", "B", "WAR"), ("t3", "t6", "B", "WAR"), ("t5", "t7", "A", "RAW"), ("t6", "t7", "B", "RAW"), ("t4", "t7", "C", "WAR"), ("t6", "t7", "C", "WAR"), ("t5", "t8", "A", "RAW"), ("t6", "t8", "B", "RAW"), ("t7", "t8", "C", "RAW"), ("t4", "t8", "D", "RAW")]


@query("q33_mdf_deps", "SELECT * FROM (VALUES " + ", ".join(map(str, _DEPS)) + ") AS t(before, after, tag, kind)")
def q33(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_four_arrays().edges, "before string, after string, tag string, kind string")


# --- keyed state and order


@query("q34_rw_epochs", "WITH e AS (SELECT event_type = 'purchase' AS w, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM events) SELECT CAST(epoch AS BIGINT) AS epoch, CAST(count(*) FILTER (NOT w) AS BIGINT) AS reads, CAST(count(*) FILTER (w) AS BIGINT) AS writes FROM e GROUP BY epoch")
def q34(spark: SparkSession, d: str) -> DataFrame:
    write = F.col("event_type") == "purchase"
    out = nodes.epochs(table(spark, d, "events").select("event_id", "event_type"), write, "event_id")
    return out.groupBy("epoch").agg(F.count_if(~write).alias("reads"), F.count_if(write).alias("writes"))


@query("q35_running_state", "SELECT event_id, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS id FROM events")
def q35(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    return nodes.running(e, "user_id", "event_id", total=F.round(F.col("value") * 100).cast("bigint"), id=F.lit(1).cast("long")).select("event_id", "user_id", "total", "id")


@query("q36_count_window", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS avg_recent FROM events")
def q36(spark: SparkSession, d: str) -> DataFrame:
    e = traffic.recent_average(table(spark, d, "events"), "user_id", "event_id", "value", 10)
    return e.select("event_id", "user_id", F.round("avg_recent", 6).alias("avg_recent"))


@query("q55_ordered_fold", "SELECT user_id, list_reduce(list_prepend(CAST(7 AS BIGINT), list(user_id + event_id ORDER BY event_id)), lambda a, v: (a * 31 + v) % 1000003) AS result FROM events GROUP BY user_id")
def q55(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("user_id") + F.col("event_id")).alias("v"))
    return loops.ordered_fold(e, "user_id", "event_id", "v", "cast(7 as bigint)", lambda a, v: (a * 31 + v) % 1000003)


# --- feedback, graphs, recursion


@query("q37_worklist", "WITH RECURSIVE w(t) AS (SELECT CAST(i AS BIGINT) FROM range(4) AS s(i) UNION ALL SELECT t + k FROM w, range(1, 4) AS s(k) WHERE k <= t % 4 AND t + t % 4 <= 40) SELECT t, CAST(count(*) AS BIGINT) AS items FROM w GROUP BY t")
def q37(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("t") % 4
    body = lambda x: x.where((r > 0) & (F.col("t") + r <= 40)).select(F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), r), lambda k: F.col("t") + k)).alias("t"))
    return iterate.feedback(spark.range(4).select(F.col("id").alias("t")), body).groupBy("t").agg(F.count("*").alias("items"))


@query("q38_feedback_counter", "WITH RECURSIVE w(n_nationkey, left_) AS (SELECT n_nationkey, CAST(n_nationkey % 6 AS INT) FROM nation UNION ALL SELECT n_nationkey, left_ - 1 FROM w WHERE left_ > 0) SELECT n_nationkey, CAST(count(*) AS BIGINT) AS rounds FROM w GROUP BY n_nationkey")
def q38(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 6).cast("int").alias("left_"))
    body = lambda x: x.where("left_ > 0").withColumn("left_", F.col("left_") - 1)
    return iterate.feedback(seeds, body).groupBy("n_nationkey").agg(F.count("*").alias("rounds"))


#: A graph of fourteen vertices.
VERTICES = [(1, "aaa"), (2, "aacb"), (3, "aaa"), (4, "baac"), (5, "abb"), (6, "bacb"), (7, "bba"), (8, "bbcb"), (9, "abbc"), (10, "ccacbb"), (11, "acbccb"), (12, "cacbbc"), (13, "aaa"), (14, "abbc")]
EDGES = [(1, 2), (1, 8), (2, 4), (2, 8), (8, 3), (4, 1), (7, 8), (7, 13), (7, 12), (6, 2), (6, 3), (6, 9), (6, 7), (6, 10), (3, 5), (3, 7), (3, 6), (5, 4), (9, 10), (9, 14), (10, 4), (10, 13), (11, 1), (11, 8), (11, 7), (12, 2), (12, 8), (12, 10), (14, 3)]
_GRAPH = f"v(id, elem) AS (VALUES {', '.join(map(str, VERTICES))}), e(src, dst) AS (VALUES {', '.join(map(str, EDGES))}), r(id) AS (SELECT 1 UNION SELECT dst FROM r JOIN e ON src = id)"


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(VERTICES, "id int, elem string"), spark.createDataFrame(EDGES, "src int, dst int")


@query("q39_graph_all", f"WITH RECURSIVE {_GRAPH} SELECT elem AS target, CAST(id AS BIGINT) AS id FROM r JOIN v USING (id) WHERE elem IN ('aaa', 'abbc', 'acbccb')")
def q39(spark: SparkSession, d: str) -> DataFrame:
    v, e = _graph(spark)
    found = [iterate.search_graph(v, e, 1, t).select(F.lit(t).alias("target"), "id") for t in ("aaa", "abbc", "acbccb")]
    return found[0].unionByName(found[1]).unionByName(found[2])


_TPCH = "e(src, dst) AS (SELECT c_custkey, 1000000000 + o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 1000000000 + l_orderkey, 2000000000 + l_partkey FROM lineitem), r(id) AS (SELECT CAST(7 AS BIGINT) UNION SELECT dst FROM r JOIN e ON src = id)"


@query("q40_graph_tpch", f"WITH RECURSIVE {_TPCH} SELECT CAST(id AS BIGINT) AS id FROM r JOIN part ON id = 2000000000 + p_partkey WHERE p_size <= 25")
def q40(spark: SparkSession, d: str) -> DataFrame:
    c, o, p, i = (table(spark, d, t) for t in ("customer", "orders", "part", "lineitem"))
    v = c.select(F.col("c_custkey").alias("id"), F.lit("c").alias("elem")).union(o.select(F.col("o_orderkey") + 1000000000, F.lit("o"))).union(p.select(F.col("p_partkey") + 2000000000, F.when(F.col("p_size") <= 25, "small").otherwise("large")))
    e = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000000).alias("dst")).union(i.select(F.col("l_orderkey") + 1000000000, F.col("l_partkey") + 2000000000))
    return iterate.search_graph(v, e, 7, "small")


@query("q41_graph_one", f"WITH RECURSIVE {_GRAPH} SELECT t.target, EXISTS (SELECT 1 FROM r JOIN v USING (id) WHERE elem = t.target) AS found FROM (VALUES ('abbc'), ('abc'), ('acbccb')) AS t(target)")
def q41(spark: SparkSession, d: str) -> DataFrame:
    v, e = _graph(spark)
    found = [(t, not iterate.search_graph(v, e, 1, t, first_only=True).isEmpty()) for t in ("abbc", "abc", "acbccb")]
    return spark.createDataFrame(found, "target string, found boolean")


@query("q42_dc_fib", "WITH RECURSIVE f(k, a, b) AS (SELECT 1, CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 20) SELECT CAST(k AS INT) AS op, a AS result FROM f WHERE k IN (2, 10, 20)")
def q42(spark: SparkSession, d: str) -> DataFrame:
    ops = spark.createDataFrame([(2,), (10,), (20,)], "op int")
    return iterate.divide_and_conquer(ops, F.col("op") <= 2, F.array(F.col("op") - 1, F.col("op") - 2), F.lit(1).cast("bigint"), lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda a, b: a + b))


@query("q43_dc_sort_sum", "SELECT CAST(sum(i * i) AS BIGINT) AS result FROM range(4096) AS t(i)")
def q43(spark: SparkSession, d: str) -> DataFrame:
    """Sums of squares over ranges [lo, hi) that are halved down to 64 numbers."""
    ops = spark.createDataFrame([(4096,)], "op bigint")
    lo, hi = F.floor(F.col("op") / (1 << 20)), F.col("op") % (1 << 20)  # a range is one number, lo * 2^20 + hi
    mid = F.floor((lo + hi) / 2)
    total = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)
    solved = total(F.transform(F.sequence(lo, hi - 1), lambda i: i * i))
    halves = F.array(lo * (1 << 20) + mid, mid * (1 << 20) + hi)
    return iterate.divide_and_conquer(ops, hi - lo <= 64, halves, solved, total).select("result")


# --- stencils and pools


@query("q44_stencil1d_loop", "SELECT CAST(j AS INT) AS j, CAST(j + 100 AS INT) AS v, CAST(1045 AS BIGINT) AS reduced, CAST(100 AS INT) AS sweeps FROM range(10) AS t(j)")
def q44(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, carry=False)


@query("q52_stencil_accum", "SELECT CAST(j AS INT) AS j, CAST(j + 100 AS INT) AS v, CAST(55000 AS BIGINT) AS reduced, CAST(100 AS INT) AS sweeps FROM range(10) AS t(j)")
def q52(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, carry=True)


def _line(spark: SparkSession, carry: bool) -> DataFrame:
    line = iterate.fixed_grid(spark, 1, 10, "j").repartition(1)  # ten cells
    out, reduced, sweeps = stencil.loop(line, (stencil.at(0, 0) + 1).cast("int"), [(0, 0)], reduce=F.sum("v"), most=100, carry_reduce=carry)
    return out.select("j", "v", F.lit(reduced).cast("bigint").alias("reduced"), F.lit(sweeps).alias("sweeps"))


_CELLS = "SELECT CAST(vec_id AS INT) AS i, CAST(t.j - 1 AS INT) AS j, CAST(floor(CAST(t.x AS DOUBLE) * {k}) AS INT) {op} AS v FROM embeddings, UNNEST(embedding) WITH ORDINALITY AS t(x, j) WHERE vec_id < 64"


def _cells(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The first 64 vectors as a square grid of integers: grids are square here, which needs as many rows as dimensions."""
    e = table(spark, d, "embeddings").where("vec_id < 64").select(F.col("vec_id").cast("int").alias("i"), F.posexplode("embedding").alias("j", "x"))
    return e.select("i", "j", F.floor(F.col("x").cast("double") * k).cast("int").alias("v"))


_RING = "FROM g a LEFT JOIN g b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND ({extra}) GROUP BY a.i, a.j"


@query("q45_box_filter", f"WITH g AS ({_CELLS.format(k=1000, op='')}) SELECT a.i, a.j, CAST(trunc(sum(b.v) / 9.0) AS INT) AS v {_RING.format(extra='TRUE')}")
def q45(spark: SparkSession, d: str) -> DataFrame:
    return stencil.loop(_cells(spark, d, 1000), stencil.box_step(), stencil.BOX)[0]


def _life_sql(steps: int) -> str:
    out = [f"g0 AS ({_CELLS.format(k=1000, op='& 1')})"]
    for k in range(steps):
        ring = _RING.format(extra="a.i <> b.i OR a.j <> b.j").replace("FROM g a", f"FROM g{k} a").replace("JOIN g b", f"JOIN g{k} b")
        out.append(f"g{k + 1} AS (SELECT a.i, a.j, CAST(CASE WHEN coalesce(sum(b.v), 0) = 3 OR (any_value(a.v) = 1 AND coalesce(sum(b.v), 0) = 2) THEN 1 ELSE 0 END AS INT) AS v {ring})")
    return f"WITH {', '.join(out)} SELECT i, j, v FROM g{steps}"


@query("q46_life", _life_sql(4))
def q46(spark: SparkSession, d: str) -> DataFrame:
    start = _cells(spark, d, 1000).withColumn("v", F.col("v").bitwiseAND(1))
    return stencil.loop(start, stencil.life_step(), stencil.BOX, most=4)[0]


_JACOBI = "(4.0 * (n.v + s.v) + 4.0 * (w.v + e.v) + -17.0 * c.v - c.f) / -17.0"


@query("q47_jacobi", f"WITH c AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST((i * 7 + j * 3) % 11 AS DOUBLE) AS v, CAST((i + j) % 5 AS DOUBLE) AS f FROM range(32) AS a(i), range(32) AS b(j)) SELECT c.i, c.j, round(CASE WHEN n.v IS NULL OR s.v IS NULL OR w.v IS NULL OR e.v IS NULL THEN c.v ELSE c.v - 0.8 * ({_JACOBI}) END, 6) AS v FROM c LEFT JOIN c n ON n.i = c.i - 1 AND n.j = c.j LEFT JOIN c s ON s.i = c.i + 1 AND s.j = c.j LEFT JOIN c w ON w.i = c.i AND w.j = c.j - 1 LEFT JOIN c e ON e.i = c.i AND e.j = c.j + 1")
def q47(spark: SparkSession, d: str) -> DataFrame:
    start = iterate.fixed_grid(spark, 32, 32, "cast((i * 7 + j * 3) % 11 as double)").withColumn("f", ((F.col("i") + F.col("j")) % 5).cast("double"))
    return stencil.loop(start, stencil.helmholtz_step(4.0, 4.0, -17.0, 0.8), stencil.CROSS, carry=["f"])[0].select("i", "j", F.round("v", 6).alias("v"))


@query("q56_sobel", f"WITH g AS ({_CELLS.format(k=100, op='')}), n AS (SELECT a.i, a.j, b.i - a.i AS di, b.j - a.j AS dj, b.v FROM g a JOIN g b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1) SELECT i, j, CAST(CASE WHEN i IN (0, 63) OR j IN (0, 63) THEN 0 ELSE least(255, abs(sum(-dj * (2 - abs(di)) * v)) + abs(sum(-di * (2 - abs(dj)) * v))) END AS INT) AS v FROM n GROUP BY i, j")
def q56(spark: SparkSession, d: str) -> DataFrame:
    return stencil.loop(_cells(spark, d, 100), stencil.sobel_step(64, 64), stencil.BOX)[0]


@query("q48_pool", "WITH RECURSIVE p(r, x) AS (SELECT 0, CAST(round(value * 100) AS BIGINT) FROM events UNION ALL SELECT r + 1, CASE WHEN x % 2 = 1 THEN x + 1 ELSE x - 1 END FROM (SELECT r, x, CAST(sum(x) OVER () AS BIGINT) // count(*) OVER () AS a, count(*) OVER () AS n FROM p) WHERE x > a AND n > 2 AND a >= 100 AND r <= 50) SELECT x FROM p WHERE r = (SELECT max(r) FROM p)")
def q48(spark: SparkSession, d: str) -> DataFrame:
    """Of a pool of numbers those above the average go on, odd ones one up and even ones one down, until two are left."""

    def average(df: DataFrame) -> int:
        return df.agg(F.expr("coalesce(sum(x) div count(*), 0)").alias("a")).first()["a"]

    def select(pool: DataFrame, env: dict) -> tuple[DataFrame, dict]:
        env = env | {"avg": average(pool)}
        return pool.where(F.col("x") > env["avg"]), env

    def stop(pool: DataFrame, env: dict) -> tuple[bool, dict]:
        return pool.count() <= 2 or env["avg"] < 100 or env["iter"] > 50, env

    step = F.when(F.col("x") % 2 == 1, F.col("x") + 1).otherwise(F.col("x") - 1)
    pool = table(spark, d, "events").select(F.round(F.col("value") * 100).cast("bigint").alias("x"))
    keep = lambda p, made, env: (made, env | {"iter": env["iter"] + 1})
    return iterate.evolve_pool(pool, {"avg": 1 << 40, "iter": 0}, select, lambda p, env: p.select(step.alias("x")), keep, stop)[0]


@query("q65_reduce_input", "SELECT CAST(45 + 10 * 2 AS BIGINT) AS reduced, CAST(45 + 10 * 3 + 1000 AS BIGINT) AS total")
def q65(spark: SparkSession, d: str) -> DataFrame:
    """Three sweeps that reduce what they read, between a hook before the first and one after the last."""
    line = iterate.fixed_grid(spark, 1, 10, "j").repartition(1)
    out, reduced, _ = stencil.loop(line, (stencil.at(0, 0) + 1).cast("int"), [(0, 0)], reduce=F.sum("v"), most=3, reduce_input=True, start=lambda g: g, end=lambda g: g.withColumn("v", F.col("v") + 100))
    return out.agg(F.lit(reduced).cast("bigint").alias("reduced"), F.sum("v").cast("bigint").alias("total"))


# --- traffic


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", (F.lit(39.689602) + k * 7919 % 43281 / F.lit(100000.0)).alias("latitude"), (F.lit(116.105789) + k * 104729 % 56424 / F.lit(100000.0)).alias("longitude"), F.col("value").alias("speed"))


def _segments(spark: SparkSession, roads: int = 20_000) -> DataFrame:
    r = F.col("id")
    x, y = F.lit(116.1) + r * 37 % 5700 / F.lit(10000.0), F.lit(39.69) + r * 53 % 4300 / F.lit(10000.0)
    return spark.range(roads).select(r.alias("road_id"), r.cast("int").alias("file_order"), F.lit(0).alias("ord"), x.alias("x1"), y.alias("y1"), (x + (r % 7 - 3) / F.lit(500.0)).alias("x2"), (y + (r % 5 - 2) / F.lit(500.0)).alias("y2"))


_ROADS = """
p AS (SELECT event_id, 39.689602::DOUBLE + (event_id * 7919 % 43281) / 100000.0::DOUBLE AS y, 116.105789::DOUBLE + (event_id * 104729 % 56424) / 100000.0::DOUBLE AS x, value AS speed FROM events),
s0 AS (SELECT r, 116.1::DOUBLE + (r * 37 % 5700) / 10000.0::DOUBLE AS x1, 39.69::DOUBLE + (r * 53 % 4300) / 10000.0::DOUBLE AS y1 FROM range(20000) AS t(r)),
s1 AS (SELECT *, x1 + (r % 7 - 3) / 500.0::DOUBLE AS x2, y1 + (r % 5 - 2) / 500.0::DOUBLE AS y2 FROM s0),
s2 AS (SELECT *, CAST(round_even((y1 + y2) / 2 * 10, 0) AS BIGINT) || '_' || CAST(round_even((x1 + x2) / 2 * 10, 0) AS BIGINT) AS cell FROM s1),
s AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY r) > 1),
j AS (SELECT p.event_id, s.r, p.x, p.y, s.x1, s.y1, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy FROM p JOIN s ON s.cell = CAST(round_even(p.y * 10, 0) AS BIGINT) || '_' || CAST(round_even(p.x * 10, 0) AS BIGINT)),
k AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) END AS t FROM j),
m AS (SELECT event_id, r, sqrt((x - (x1 + t * dx)) * (x - (x1 + t * dx)) + (y - (y1 + t * dy)) * (y - (y1 + t * dy))) * 111.2 * 1000 AS d FROM k),
b AS (SELECT event_id, min(r) FILTER (d < 2.5) AS hit, arg_min(r, (d, r)) AS near FROM m WHERE d < 11.180339887498949 GROUP BY event_id)"""


@query("q49_map_match", f"WITH {_ROADS} SELECT p.event_id, CAST(coalesce(hit, near, -1) AS BIGINT) AS road_id FROM p LEFT JOIN b USING (event_id)")
def q49(spark: SparkSession, d: str) -> DataFrame:
    return traffic.match(_points(spark, d), traffic.grid(_segments(spark))).select("event_id", "road_id")


def _speed_sql(window: int) -> str:
    """Common tables from ``e`` (key, ord, speed, k: 1, 2, ... in a key) on: ``r`` has a road's state after each tuple."""
    return f"""r(key, ord, k, q, total, squares, average) AS (
  SELECT key, ord, k, [speed], speed, speed * speed, speed FROM e WHERE k = 1
  UNION ALL
  SELECT key, ord, k, CASE WHEN take THEN list_append(q, speed) ELSE q END, CASE WHEN take THEN total + speed ELSE total END, CASE WHEN take THEN squares + speed * speed ELSE squares END,
    CASE WHEN n <= 1 THEN (total + speed) / (n + 1) WHEN take THEN mean ELSE average END
  FROM (SELECT *, n <= 1 OR (spread >= 0 AND abs(speed - mean) <= 2 * sqrt(greatest(spread, 0))) AS take
    FROM (SELECT *, ((squares + speed * speed) - (n + 1) * mean * mean) / n + 1 AS spread
      FROM (SELECT *, (total + speed) / n + 1 AS mean
        FROM (SELECT e.key, e.ord, e.k, e.speed, CASE WHEN len(r.q) > {window} - 1 THEN r.q[2:] ELSE r.q END AS q, CASE WHEN len(r.q) > {window} - 1 THEN len(r.q) - 1 ELSE len(r.q) END AS n,
          CASE WHEN len(r.q) > {window} - 1 THEN r.total - r.q[1] ELSE r.total END AS total, r.squares, r.average FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)))))"""


@query("q68_road_source", f"WITH {_ROADS} SELECT cell, CAST(count(*) AS BIGINT) AS segments, CAST(sum(r) AS BIGINT) AS roads FROM s GROUP BY cell")
def q68(spark: SparkSession, d: str) -> DataFrame:
    """Prepared segments: written once, with their cells, and read as the road source."""
    folder = streams.shared_folder(spark, "roads")
    traffic.grid(_segments(spark)).select("cell", "road_id", "file_order", "ord", "x1", "y1", "x2", "y2").write.parquet(folder)
    return road_segments(spark, folder).groupBy("cell").agg(F.count("*").alias("segments"), F.sum("road_id").alias("roads"))


@query("q50_speed_reference", f"WITH RECURSIVE e AS (SELECT CAST(user_id AS BIGINT) AS key, CAST(event_id AS BIGINT) AS ord, CAST(value AS DOUBLE) AS speed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), {_speed_sql(50)} SELECT key, ord, average FROM r")
def q50(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("road_id"), F.col("value").alias("speed"))
    return traffic.speeds(e, window=50)


_BOX = "y BETWEEN 39.689602 AND 40.122410 AND x BETWEEN 116.105789 AND 116.670021 AND speed >= 0"


@query(
    "q51_traffic",
    f"WITH RECURSIVE {_ROADS}, hit AS (SELECT coalesce(hit, near) AS key, p.event_id AS ord, CAST(p.speed AS DOUBLE) AS speed FROM p JOIN b USING (event_id) WHERE {_BOX} AND coalesce(hit, near, -1) <> -1), "
    f"e AS (SELECT CAST(key AS BIGINT) AS key, ord, speed, row_number() OVER (PARTITION BY key ORDER BY ord) AS k FROM hit), {_speed_sql(traffic.WINDOW)} "
    "SELECT key AS road_id, CAST(count(*) AS BIGINT) AS n, round(arg_max(average, ord), 6) AS last_average FROM r GROUP BY key",
)
def q51(spark: SparkSession, d: str) -> DataFrame:
    return traffic.monitor(_points(spark, d), _segments(spark))


@query("q57_in_polygon", "SELECT event_id, (value BETWEEN 100 AND 300 AND user_id BETWEEN 20 AND 100) AS inside FROM events WHERE value NOT IN (100, 300) AND user_id NOT IN (20, 100)")
def q57(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value NOT IN (100, 300) AND user_id NOT IN (20, 100)")
    return e.select("event_id", geo.in_polygon(F.col("value"), F.col("user_id"), [(100.0, 20.0), (300.0, 20.0), (300.0, 100.0), (100.0, 100.0)]).alias("inside"))


# --- streams


@query("s01_stream_wordcount", f"WITH {TOKENS} SELECT word, CAST(count(*) AS BIGINT) AS cnt FROM tokens GROUP BY word")
def s01(spark: SparkSession, d: str) -> DataFrame:
    split = Stage(lambda x: x.select(F.explode(space_tokens("text_line")).alias("word")).withColumn("word", F.substring("word", 1, 31)))
    lines = Stage(lambda x: x.select(F.explode(F.split("text", "\n")).alias("text_line")))
    count = Stage(lambda x: x.groupBy("word").agg(F.count("*").alias("cnt")))
    return streams.drain(streams.run_stream(Pipeline((lines, Farm(split, 4), count)), streams.table_stream(spark, d, "documents")), "complete", "words")


@query("s02_stream_state", "SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS seen, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id")
def s02(spark: SparkSession, d: str) -> DataFrame:
    e = streams.table_stream(spark, d, "events").select(F.col("user_id").cast("long").alias("user_id"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    out = streams.keyed_fold(e, "user_id", (0, 0), lambda s, r: (s[0] + 1, s[1] + int(r[0])), ["cents"], "seen long, cents long", "user_id long, seen long, cents long")
    updates = streams.drain(out, "update", "state")
    return updates.groupBy("user_id").agg(F.max_by("seen", "batch").alias("seen"), F.max_by("cents", "batch").alias("cents"))


@query("s03_stream_windows", "SELECT CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def s03(spark: SparkSession, d: str) -> DataFrame:
    out = streams.windowed(streams.table_stream(spark, d, "events"), "ts", "400 days", "1 hour", None, ["event_type"], n=F.count("*"))
    return streams.drain(out, "complete", "windows").select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n")


@query("s04_stream_sliding", "SELECT CAST(epoch(time_bucket(INTERVAL '30 minutes', ts)) - 1800 * k AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS n FROM events, range(2) AS t(k) GROUP BY 1")
def s04(spark: SparkSession, d: str) -> DataFrame:
    out = streams.windowed(streams.table_stream(spark, d, "events"), "ts", "1 day", "1 hour", "30 minutes", [], n=F.count("*"))
    return streams.drain(out, "complete", "sliding").select(F.unix_timestamp("window_start").alias("window_start"), "n")


@query("s05_stream_sessions", "WITH e AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 43200000000 THEN 0 ELSE 1 END AS opens FROM e), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT CAST(user_id AS BIGINT) AS user_id, CAST(min(t) // 1000000 AS BIGINT) AS session_start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def s05(spark: SparkSession, d: str) -> DataFrame:
    out = streams.sessions(streams.table_stream(spark, d, "events"), "ts", "1 day", "12 hours", ["user_id"], n=F.count("*"))
    return streams.drain(out, "complete", "sessions").select(F.col("user_id").cast("long").alias("user_id"), F.unix_timestamp("session_start").alias("session_start"), "n")


@query("s06_stream_loop", "WITH RECURSIVE w(n_nationkey, left_) AS (SELECT n_nationkey, CAST(n_nationkey % 6 AS INT) FROM nation UNION ALL SELECT n_nationkey, left_ - 1 FROM w WHERE left_ > 0) SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(left_ AS INT) AS left_ FROM w WHERE left_ = 0")
def s06(spark: SparkSession, d: str) -> DataFrame:
    """A counter that goes round until it is zero, within each batch of a stream."""
    step = Stage(lambda x: x.withColumn("left_", F.greatest(F.col("left_") - 1, F.lit(0))))
    items = streams.table_stream(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), (F.col("n_nationkey") % 6).cast("int").alias("left_"))
    return streams.run_loops(Pipeline((step,)).wrap_around(F.col("left_") == 0), items)


@query("s07_frozen", "SELECT CAST(w AS INT) AS workers, user_id % 5 AS k, CAST(count(*) AS BIGINT) AS items FROM events, (VALUES (1), (3)) AS t(w) GROUP BY 1, 2")
def s07(spark: SparkSession, d: str) -> DataFrame:
    """One graph, run and frozen, then thawed with more workers."""
    graph = streams.Frozen(Farm(Stage(lambda x: x.groupBy((F.col("user_id") % 5).alias("k")).agg(F.count("*").alias("items"))), 3))
    made = [graph.run_then_freeze(table(spark, d, "events").select("user_id"), w).select(F.lit(w).alias("workers"), "k", "items") for w in (1, 3)]
    return made[0].unionByName(made[1])


_BATCH = "CAST((event_id - lo) // greatest(1, (hi - lo + 4) // 4) AS INT)"


@query(
    "s08_stream_late",
    f"WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events), e AS (SELECT event_id, epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS t, {_BATCH} AS batch FROM events, b), "
    "m AS (SELECT batch, max(t) AS top FROM e GROUP BY batch), w AS (SELECT a.batch, max(m.top) - 86400 AS mark FROM m a JOIN m ON m.batch < a.batch - 1 GROUP BY a.batch), "
    "k AS (SELECT e.t // 3600 * 3600 AS window_start FROM e LEFT JOIN w USING (batch) WHERE w.mark IS NULL OR e.t // 3600 * 3600 + 3600 > w.mark) "
    "SELECT CAST(window_start AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS n FROM k WHERE window_start + 3600 <= (SELECT max(top) FROM m) - 86400 GROUP BY window_start",
)
def s08(spark: SparkSession, d: str) -> DataFrame:
    """Hours in append mode: rows that come after their hour is closed are dropped, and hours still open are not given."""
    source = streams.arrivals(table(spark, d, "events").select("event_id", "ts"), "event_id", 4)
    out = streams.windowed(source, "ts", "1 day", "1 hour", None, [], n=F.count("*"))
    return streams.drain(out, "append", "late").select(F.unix_timestamp("window_start").alias("window_start"), "n")
