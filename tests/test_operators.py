from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.apps import wordcount
from weftline.apps.traffic import RoadSpeed, grid, match, recent_average, speeds
from weftline.catalog import QUERIES
from weftline.operators import iterate, loops, nodes, routing, stencil
from weftline.operators.tasks import TaskGraph
from weftline.plans.graph import AllToAll, Combined, Farm, Group, Pipeline, Selector, Stage, TopologyError, connection, validate
from weftline.plans.lower import run
from weftline.plans.rewrite import combine, combine_farms, combine_ordered, optimise
from weftline.sources.readers import generate, incomplete, records, replay_for, text_file_lines
from weftline.streaming.queries import Accelerator, check_streamable

IDENTITY = Stage(lambda x: x)
MULTI = Stage(lambda x: x, multi_in=True, multi_out=True)


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=lambda r: [(v is not None, v) for v in r])


def test_generator_with_condition_and_without_items(spark):
    assert [r[0] for r in generate(spark, 0, lambda i: i < 10, 4).orderBy("seq").collect()] == [0, 4, 8]
    assert generate(spark, 5, lambda i: i < 5, 1).count() == 0


def test_lines_of_a_file_are_numbered_and_empty_ones_dropped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n" + "x" * 200 + "\n")
    assert values(text_file_lines(spark, str(tmp_path)), "line", "text_line")[:2] == [(0, "one"), (1, "two")]
    assert text_file_lines(spark, str(tmp_path), max_line=128).count() == 2


def test_records_turn_garbage_to_zero_and_count_short_lines(spark):
    df = spark.createDataFrame([("1,2.5,x",), ("7up,zz,y",), ("1,2",)], "line string")
    assert values(records(df, "line", [(0, "a", "int"), (1, "b", "double"), (2, "c", "string")], 3), "a", "b", "c") == [(1, 2.5, "x"), (7, 0.0, "y")]
    assert incomplete(df, "line", 3).first()[0] == 1


def test_take_while_without_channel(spark):
    df = spark.range(10)
    assert nodes.take_while(df, "id = 4", "id").count() == 4
    assert nodes.take_while(df, "id > 99", "id").count() == 10


def test_callbacks_see_items_in_and_out(spark):
    out, seen, made = nodes.with_callbacks(spark.range(10), "n", lambda d: [F.count("*").alias("n")], lambda d: d.where("id > 6"), lambda d: [F.count("*").alias("n")])
    assert out.count() == 3 and seen.get["n"] == 10 and made.get["n"] == 3


@pytest.mark.parametrize(("lefts", "rights"), [(1, 4), (3, 8), (4, 4), (5, 12)])
def test_scatter_gives_each_sender_consecutive_chunks(spark, lefts, rights):
    got = values(routing.scatter(spark.range(rights * 2), "id", rights * 2, lefts, rights).select("left", "right").distinct(), "left", "right")
    small, extra = divmod(rights, lefts)
    want, at = [], 0
    for sender in range(lefts):
        for _ in range(small + (sender < extra)):
            want.append((sender, at))
            at += 1
    assert got == sorted(want)


def test_multicast_and_route(spark):
    df = routing.multicast(spark.range(3), F.array(F.lit(0), F.lit(2)))
    assert values(df, "id", "worker") == [(k, w) for k in range(3) for w in (0, 2)]
    parts = routing.route(spark.range(20), routing.by_number("id", 4), 4).withColumn("p", F.spark_partition_id())
    assert parts.groupBy("p").agg(F.count_distinct("worker").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("workers", [1, 3, 8])
def test_static_blocks_cover_all_and_differ_by_one(spark, workers):
    sizes = [r[1] for r in loops.indices(spark, 0, 101).groupBy(loops.static_worker("k", 101, workers)).count().collect()]
    assert sum(sizes) == 101 and max(sizes) - min(sizes) <= 1 and len(sizes) == workers


def test_reduction_without_items_is_the_initial_value(spark):
    assert loops.reduce_all(spark.range(0), total=("+", "id", 7), low=("min", "id", 9)).first().asDict() == {"total": 7, "low": 9}


def test_graph_search_quirks(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, elem string")
    e = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "src int, dst int")
    assert values(iterate.search_graph(v, e, 1, "a"), "id") == [(1,)]
    assert iterate.search_graph(v, e, 1, "z", first_only=True).isEmpty()
    assert iterate.search_graph(v, e, 9, "a").isEmpty()


def test_feedback_over_a_cycle_ends_with_distinct(spark):
    step = lambda f: f.select(((F.col("x") + 1) % 5).alias("x"))
    assert values(iterate.feedback(spark.createDataFrame([(0,)], "x int"), step, distinct=["x"]), "x") == [(k,) for k in range(5)]


def test_stencil_carries_its_reduction_or_not(spark):
    line = iterate.fixed_grid(spark, 1, 4, "j")
    for carry, want in ((False, 18), (True, 10 + 14 + 18)):
        out, total, sweeps = stencil.loop(line, (stencil.at(0, 0) + 1).cast("int"), [(0, 0)], reduce=F.sum("v"), most=3, carry_reduce=carry)
        assert (total, sweeps) == (want, 3) and values(out, "j", "v") == [(j, j + 3) for j in range(4)]


def test_stencil_stops_by_condition_and_keeps_cells_outside(spark):
    line = iterate.fixed_grid(spark, 1, 4, "j")
    _, _, sweeps = stencil.loop(line, (stencil.at(0, 0) + 1).cast("int"), [(0, 0)], reduce=F.sum("v"), most=9, go_on=lambda total, _: total < 14)
    assert sweeps == 2
    out, _, _ = stencil.loop(line, (stencil.at(0, 0) + 1).cast("int"), [(0, 0)], most=1, within=F.col("j") > 1)
    assert values(out, "j", "v") == [(0, 0), (1, 1), (2, 3), (3, 4)]


def test_life_blinks(spark):
    start = spark.createDataFrame([(i, j, int(i == 2 and 1 <= j <= 3)) for i in range(5) for j in range(5)], "i int, j int, v int")
    once, _, _ = stencil.loop(start, stencil.life_step(), stencil.BOX)
    assert values(once.where("v = 1"), "i", "j") == [(1, 2), (2, 2), (3, 2)]
    twice, _, _ = stencil.loop(once, stencil.life_step(), stencil.BOX)
    assert values(twice, "i", "j", "v") == values(start, "i", "j", "v")


def test_pool_ends_at_once_and_evolves(spark):
    pool = spark.range(4).select(F.col("id").alias("x"))
    out, env = iterate.evolve_pool(pool, {"n": 0}, lambda p, e: (p.where("x > 0"), e), lambda p, e: p.withColumn("x", F.col("x") - 1), lambda p, b, e: (b, {"n": e["n"] + 1}), lambda p, e: (p.count() <= 1, e))
    assert env == {"n": 3} and values(out, "x") == [(0,)]


def test_task_graph_executes_in_order_of_dependencies(spark):
    g = TaskGraph().add("a", lambda: spark.range(3), (), ("X",)).add("b", lambda x: x.where("id > 0"), ("X",), ("Y",)).add("c", lambda x, y: x.join(y, "id"), ("X", "Y"), ("X",))
    assert ("a", "b", "X", "RAW") in g.edges and ("b", "c", "X", "WAR") in g.edges
    assert g.execute({}, lambda _, df: df.count()) == {"a": 3, "b": 2, "c": 2}


def test_connections_and_errors():
    farm, two = Farm(IDENTITY, 3, has_collector=False), AllToAll(MULTI, 3, MULTI, 2)
    assert connection(farm, MULTI) == "gather"
    assert connection(farm, two) == "pairwise"
    assert connection(Farm(MULTI, 4, has_collector=False), two) == "bipartite"
    assert connection(MULTI, two) == "routed"
    for bad in (Pipeline((farm, IDENTITY)), Pipeline((IDENTITY, two)), Pipeline((Farm(IDENTITY, 2, has_collector=False), two)), Farm(Farm(IDENTITY, 2), 2, ordered=True), AllToAll(Farm(IDENTITY, 2), 1, IDENTITY, 1), Pipeline((IDENTITY, farm)).wrap_around(), Pipeline(())):
        with pytest.raises(TopologyError):
            validate(bad)


def test_types_are_checked(spark):
    a = spark.range(1).schema
    b = spark.range(1).select(F.col("id").cast("string").alias("id")).schema
    with pytest.raises(TypeError):
        validate(Pipeline((Stage(lambda x: x, gives=a), Stage(lambda x: x, takes=b))))


def test_rewrites_keep_results_and_order(spark):
    add = lambda n: Farm(Stage(lambda x, n=n: x.withColumn("id", F.col("id") + n)), 3)
    graph = Pipeline((add(1), Pipeline((add(2), Farm(Stage(lambda x: x.where("id % 2 = 0")), 2)))))
    best = optimise(graph)
    assert isinstance(best, AllToAll) and values(run(best, spark.range(9)), "id") == values(run(graph, spark.range(9)), "id")
    order = Farm(IDENTITY, 3, ordered=True)
    kept = optimise(Pipeline((order, Farm(IDENTITY, 3))))
    assert isinstance(kept, Pipeline) and len(kept.stages) == 2
    assert isinstance(optimise(Pipeline((order, order))), Farm)
    assert isinstance(combine(IDENTITY, IDENTITY), Combined)
    assert optimise(Pipeline((IDENTITY, add(1)))).emitter is IDENTITY


def test_editing_a_pipeline_and_selecting(spark):
    p = Pipeline((IDENTITY,)).append(MULTI).insert(1, Stage(lambda x: x.where("id > 1"))).prepend(MULTI)
    assert len(p.stages) == 4 and len(p.remove(2).stages) == 3 and p.change(IDENTITY, MULTI).stages[1] is MULTI
    s = Selector((IDENTITY, Stage(lambda x: x.where("id > 2"))))
    assert run(s, spark.range(5)).count() == 5 and run(s.select(1), spark.range(5)).count() == 2
    assert (Group("g") << IDENTITY).nodes == (IDENTITY,)


def test_wrapped_pipeline_loops_until_done(spark):
    halve = Stage(lambda x: x.withColumn("id", F.floor(F.col("id") / 2)))
    loop = Pipeline((halve,)).wrap_around(F.col("id") <= 1)
    assert values(run(loop, spark.range(4, 9)), "id") == [(1,)] * 5
    with pytest.raises(TopologyError):
        check_streamable(loop)


def test_accelerator(spark):
    acc = Accelerator(spark, Farm(Stage(lambda x: x.selectExpr("v * 2 AS v")), 2), "v int", batch_items=3)
    assert acc.load_result_nb() is None
    acc.offload((1,), (2,))
    acc.offload((3,), (4,))
    acc.end()
    got = []
    while (r := acc.load_result()) is not None:
        got.append(r.v)
    assert sorted(got) == [2, 4, 6, 8]
    with pytest.raises(RuntimeError):
        acc.offload((5,))


@pytest.mark.parametrize("corrected", [False, True])
def test_speeds_follow_one_state_a_road(spark, corrected):
    r = random.Random(1)
    data = [(k, k % 3, r.uniform(10, 90)) for k in range(600)]
    states, want = {}, {}
    for k, road, speed in data:
        want[k] = states.setdefault(road, RoadSpeed(20, corrected)).add(speed)
    got = speeds(spark.createDataFrame(data, "event_id long, road_id long, speed double"), window=20, corrected=corrected)
    assert {x.ord: x.average for x in got.collect()} == want


def test_speed_reference_by_hand():
    s = RoadSpeed(3)
    assert s.add(10.0) == 10.0 and s.add(20.0) == 15.0
    assert s.add(30.0) == 15.0 and list(s.speeds) == [10.0, 20.0]  # a negative radicand rejects
    for corrected, squares in ((False, 1400.0), (True, 1300.0)):
        s = RoadSpeed(2, corrected)
        assert [s.add(x) for x in (10.0, 20.0, 30.0)] == [10.0, 15.0, 25.0]
        assert s.squares == squares and list(s.speeds) == [20.0, 30.0]


def test_running_sums_in_blocks_are_those_of_one_window(spark):
    r = random.Random(2)
    rows = [(k * 3 + r.randint(0, 2), r.choice(["a", "a", "a", "b", None]), r.randint(-5, 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "at long, key string, v long").repartition(3)
    for size in (1, 7, 1000):
        want, seen, total = [], {}, {}
        for at, key, v in sorted(rows):
            seen[key], total[key] = seen.get(key, 0) + 1, total.get(key, 0) + v
            want.append((at, seen[key], total[key]))
        assert values(nodes.running(df, "key", "at", size, n=F.lit(1), total=F.col("v")), "at", "n", "total") == sorted(want)
        last = values(recent_average(df.where("key = 'a'"), "key", "at", "v", 4, size + 3), "at", "avg_recent")
        only = [(at, v) for at, key, v in sorted(rows) if key == "a"]
        assert last == [(at, pytest.approx(sum(x for _, x in only[max(0, k - 3) : k + 1]) / len(only[max(0, k - 3) : k + 1]))) for k, (at, _) in enumerate(only)]
    assert nodes.running(df.limit(0), "key", "at", n=F.lit(1)).count() == 0


def test_even_blocks_follow_the_order_and_the_weight_however_they_are_spread(spark):
    r = random.Random(4)
    at = [*range(300), *(10**12 + 7 * k for k in range(300)), *[5] * 20, *[None] * 3]
    rows = [(k, x, r.randint(1, 40) if x is not None and x < 300 else 400) for k, x in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, at long, w long").repartition(3)
    block, blocks = nodes.even_blocks(df, "at", F.col("w"), 4000)
    got = {i: b for i, b in values(df.select("id", block.alias("b")), "id", "b")}
    placed = sorted((x is None, x or 0, got[k]) for k, x, _ in rows)
    assert [b for *_, b in placed] == sorted(got.values()) and {*got.values()} == {*range(blocks)}
    assert len({(x, b) for _, x, b in placed}) == len({(n, x) for n, x, _ in placed})
    assert 20 <= blocks <= 40 and max(sum(w for k, _, w in rows if got[k] == b) for b in range(blocks)) <= 2 * 4000
    assert nodes.even_blocks(df.limit(0), "at", F.col("w"), 10)[1] == nodes.even_blocks(df.where("at IS NULL"), "at", F.col("w"), 10)[1] == 1


def shuffled_rows(df) -> int:
    """Rows that all exchanges of ``df``, which has run, have written."""
    seen, total, todo = set(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec" and plan.id() not in seen:
            seen.add(plan.id())
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        todo += inner or [plan.children().apply(k) for k in range(plan.children().size())]
    return total


def test_running_word_counts_shuffle_texts_and_counts_of_blocks_but_not_words(spark):
    r = random.Random(3)
    ids = [*range(40), *(10**15 + k for k in range(40)), None]
    docs = [(k, "\n".join(" ".join(r.choices(["the", "a", "b\tc", "x" * 40, "", f"w{k}"], [9, 3, 1, 1, 1, 1], k=r.randint(0, 60))) for _ in range(r.randint(1, 4))), k and k % 7) for k in ids]
    docs.append((-3, None, 1))
    want, seen = [], {}
    for at, text, ts in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for line, words in enumerate((text or "").split("\n")):
            for pos, word in enumerate(w[:31] for w in words.split(" ") if w):
                seen[word] = seen.get(word, 0) + 1
                want.append((at, line, pos, word, ts, seen[word]))
    df = spark.createDataFrame(docs, "doc_id long, text string, ts long").repartition(4)
    for size in (300, 5000, 1 << 30):
        out = wordcount.running(df, size, carry=("ts",))
        got = [tuple(x) for x in out.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        assert out.columns == ["doc_id", "line", "pos", "word", "ts", "id"]
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("the cat and the dog and the cat " * 20).alias("text"))
    got = wordcount.running(docs)
    assert got.count() == len(got.collect()) == 200 * 160
    assert 2 * 200 <= shuffled_rows(got) < 200 * 160 / 10  # texts twice, and a row for each block and word


def test_stamped_word_count_shuffles_no_row_for_each_word(spark, tmp_path):
    docs = spark.range(200).select((F.col("id") * 3).alias("doc_id"), F.lit("the cat and the dog and the cat " * 20).alias("text"), (F.col("id") + 7).alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["q70_wordcount_stamped"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((w, k, 7) for w in ("the", "cat", "and", "dog") for k in (1, 2, 3))
    assert 2 * 200 <= shuffled_rows(got) < 200 * 160 / 10


def test_control_messages_hold_from_their_place_on(spark):
    control = spark.createDataFrame([(3, 10), (7, 20)], "at long, x long")
    got = values(routing.managed(spark.range(10).select(F.col("id").alias("at"), (F.col("id") * 2).alias("v")), control, "at", "x", rows=2), "at", "v", "control")
    assert {a: (v, c) for a, v, c in got} == {k: (2 * k, None if k < 3 else 10 if k < 7 else 20) for k in range(10)}


def test_farms_are_combined_in_eight_ways_with_one_result(spark):
    add = lambda n: Stage(lambda x: x.withColumn("id", F.col("id") + n))
    times = Stage(lambda x: x.withColumn("id", F.col("id") * 3))
    for merge in (False, True):
        for n1, n2 in ((None, None), (add(1), None), (None, times), (add(1), times)):
            for workers in (2, 3):
                a, b = Farm(add(5), 2), Farm(times, workers)
                made = combine_farms(a, n1, n2, b, merge)
                plain = Pipeline((a.worker, *[n for n in (n1, n2) if n], b.worker))
                validate(made)
                assert values(run(made, spark.range(20)), "id") == values(run(plain, spark.range(20)), "id")
                assert len(made.stages) == (2 if merge and (n1 or n2) else 1)
                if merge and not n1 and not n2:
                    assert isinstance(made.stages[0], Farm if workers == 2 else AllToAll)
    kept = combine_ordered(Farm(IDENTITY, 2, ordered=True), Farm(times, 3, emitter=add(1)))
    assert [s.collector is not None for s in kept.stages] == [True, False] and kept.stages[1].emitter is None
    out = [r.id for r in run(kept, spark.range(10).withColumn("seq", F.col("id"))).collect()]
    assert sorted(out) == [3 * (k + 1) for k in range(10)]
    with pytest.raises(ValueError):
        combine_ordered(Farm(IDENTITY, 2), Farm(IDENTITY, 2))


def test_graphs_are_edited_before_they_run(spark):
    plus = Stage(lambda x: x.withColumn("id", F.col("id") + 1))
    farm = Farm(IDENTITY, 2).change_workers(plus, 5).change_emitter(plus).change_collector(plus)
    assert farm.workers == 5 and values(run(farm, spark.range(2)), "id") == [(3,), (4,)]
    a2a = AllToAll(IDENTITY, 1, IDENTITY, 2).change_firstset(plus).change_secondset(plus, 4)
    assert a2a.rights == 4 and values(run(a2a, spark.range(1)), "id") == [(2,)]
    assert values(run(Combined(IDENTITY, IDENTITY).change_first(plus).change_last(plus), spark.range(1)), "id") == [(2,)]
    assert values(run(Pipeline((Group("g") << plus << plus, plus)), spark.range(1)), "id") == [(3,)]


def test_ordered_state_of_a_key_is_streamed(spark):
    def step(state: list, row: tuple) -> int:
        state[0] = (state[0] * 31 + row[0]) % 1_000_003
        return state[0]

    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), (F.col("id") * 7).alias("v")).repartition(4)
    got = {(r.key, r.ord): r.out for r in loops.keyed_scan(df, "k", "at", ["v"], lambda: [7], step, "out long").collect()}
    for k in range(3):
        state = [7]
        for at in range(k, 500, 3):
            assert got[k, at] == step(state, (at * 7,))


def test_replay_ends_with_a_whole_pass(spark):
    seen = []
    passes, items = replay_for(spark.range(5), lambda df, k: seen.append((k, df.count())), 0.5, per_second=50)
    assert passes >= 2 and items == 5 * passes and seen == [(k, 5) for k in range(passes)]


def test_points_meet_the_segments_near_them(spark):
    r = random.Random(6)
    roads = [(k, k, 0, *(round(116.3 + r.uniform(-0.004, 0.004), 6) if c in "x" else round(39.9 + r.uniform(-0.004, 0.004), 6) for c in "xyxy")) for k in range(60)]
    roads += [(60, 60, 0, 116.3, 39.9, 116.3, 39.906), (61, 61, 0, 116.3, 39.9, 116.3, 39.9), (62, 62, 0, 116.296, 39.9, 116.305, 39.9)]
    points = [(k, 116.3 + r.uniform(-0.004, 0.004), 39.9 + r.uniform(-0.004, 0.004)) for k in range(400)]
    segments = spark.createDataFrame(roads, "road_id long, file_order int, ord int, x1 double, y1 double, x2 double, y2 double")
    got = {x.event_id: x.road_id for x in match(spark.createDataFrame(points, "event_id long, longitude double, latitude double"), grid(segments, drop_first=False)).collect()}
    cell = lambda x, y: (round(y * 10), round(x * 10))

    def distance(x, y, x1, y1, x2, y2):
        size = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / size)) if size else 0
        return ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5 * 111200

    for k, x, y in points:
        near = [(distance(x, y, *s[3:]), s[0]) for s in roads if cell(x, y) == cell((s[3] + s[5]) / 2, (s[4] + s[6]) / 2)]
        near = [n for n in near if n[0] < 5 * 5**0.5]
        on = [i for d, i in near if d < 2.5]
        assert got[k] == (min(on) if on else min(near)[1] if near else -1)
