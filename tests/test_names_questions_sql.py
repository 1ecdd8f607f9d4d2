from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymart.operators import numbering, questions, resolve
from tallymart.plans import adhoc
from tests.conftest import values_of


def resolved(spark, names, dimension, column):
    inputs = spark.createDataFrame([(n,) for n in names], "typed string")
    return dict(values_of(resolve.resolve_names(inputs, dimension, column)))


def test_names(spark, star):
    got = resolved(spark, ["牛肉Poke", "拉面", "", None, "zzz", "来一份绿茶吧"], star.products, "product_name")
    assert got == {
        "牛肉Poke": "牛肉poke", "拉面": "味增拉面", "": None, None: None, "zzz": None,
        "来一份绿茶吧": "绿茶",
    }
    assert resolved(spark, ["harbour", "  HARBOUR poke "], star.stores, "store_name") == {
        "harbour": "Harbour Poke", "  HARBOUR poke ": "Harbour Poke",
    }


def test_categories(spark, star):
    inputs = spark.createDataFrame([(t,) for t in ["饮品", "饮料类", "主食", "点", "zzz", None]], "t string")
    assert dict(values_of(resolve.resolve_categories(inputs, star.products))) == {
        "饮品": "饮料", "饮料类": "饮料", "主食": "主食", "点": "点心", "zzz": None, None: None,
    }


def by_hand(text, names, suffix="", aliases=()):
    """The rules, one candidate at a time."""
    if not text:
        return None
    target = text.strip().lower()
    ordered = sorted(names, key=lambda n: (-len(n), n))
    bare = lambda s: s.replace(suffix, "") if suffix else s
    tests = [
        lambda n: n.lower() == target,
        lambda n: bare(target) in aliases and bare(n.lower()) in aliases,
        lambda n: bare(target) in bare(n.lower()) or bare(n.lower()) in bare(target),
    ]
    for test in tests:
        for name in ordered:
            if test(name):
                return name
    return None


@pytest.mark.parametrize(("suffix", "aliases"), [("", []), ("x", ["ab", "ba"])])
def test_joins_and_scalar_agree_with_brute_force(spark, suffix, aliases):
    draw = random.Random(7)
    word = lambda a, b: "".join(draw.choice("abxAB ") for _ in range(draw.randint(a, b)))
    names = sorted({word(1, 5) for _ in range(25)})
    texts = sorted({word(0, 7) for _ in range(60)})
    dimension = spark.createDataFrame([(n,) for n in names], "name string")
    inputs = spark.createDataFrame([(t,) for t in texts], "t string")
    expected = {t: by_hand(t, names, suffix, aliases) for t in texts}
    if suffix:
        df = resolve.resolve_categories(inputs, dimension, "name", suffix, aliases)
    else:
        df = resolve.resolve_names(inputs, dimension, "name")
    assert dict(values_of(df)) == expected
    for text in texts[::6]:
        if suffix:
            best = resolve.best_category(dimension, text, suffix, aliases, "name")
        else:
            best = resolve.best_name(dimension, "name", text)
        assert spark.range(1).select(best).first()[0] == expected[text]


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.fixture(scope="module")
def talk(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"q{t}") for t in range(60)]
    return log(spark, [*turns, (2, 0, "system", "s"), (2, 1, "user", "only"), (3, 0, "system", "s")])


def test_history(talk):
    kept = questions.last_questions(talk, 3).where("conv_id = 1").orderBy("turn")
    assert [(r.turn, r.position) for r in kept.collect()] == [(54, 1), (56, 2), (58, 3)]
    assert dict(values_of(questions.first_question(talk))) == {1: "q20", 2: "only"}
    assert dict(values_of(questions.first_question(talk, 100))) == {1: "q0", 2: "only"}


@pytest.mark.parametrize("turns_per_task", [1, 3, 7, 1000])
def test_previous_question_across_stretches(talk, turns_per_task):
    rows = questions.previous_question(talk, turns_per_task).orderBy("conv_id", "turn").collect()
    asked = [r for r in rows if r.conv_id == 1]
    assert [r.previous for r in asked] == [None, *[r.text for r in asked[:-1]]]
    assert [r.previous for r in rows if r.conv_id == 2] == [None]


def test_routes(spark):
    texts = ["什么饮品卖得最好", "哪个商品卖得最好?", "最近客单价趋势", "你好", None]
    df = questions.route(log(spark, [(1, i, "user", t) for i, t in enumerate(texts)]), planned={"tool": F.lit("general_qa"), "store_name": F.col("role"), "limit": F.col("turn") + 5})
    rows = {r.turn: (r.tool, r.order, r.limit, r.category, r.store_name) for r in df.collect()}
    assert rows == {
        0: ("product_rank", "desc", 1, "饮品", None), 1: ("product_rank", "desc", 1, None, None),
        2: ("aov_trend", None, None, None, None), 3: ("general_qa", None, 8, None, "user"),
        4: ("general_qa", None, 9, None, "user"),
    }
    with pytest.raises(ValueError, match="colour"):
        questions.route(df, planned={"colour": F.lit(1)})


def test_previous_question_of_a_null_conversation(spark):
    rows = [(None, i, "user", f"q{i}") for i in range(4)]
    got = questions.previous_question(log(spark, rows), 1).orderBy("turn").collect()
    assert [r.previous for r in got] == [None, "q0", "q1", "q2"]


def test_follow_ups(spark):
    df = questions.follow_up(log(spark, [(1, 0, "user", "那它呢"), (1, 1, "user", "hello"), (1, 2, "assistant", "那")]))
    assert {r.turn: r.is_follow_up for r in df.collect()} == {0: True, 1: False}


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE sales", "select 1; select 2", "with x as (select 1) insert into t select * from x",
        "explain select 1", "", "/* ' */ drop table x /* ' */", "-- select\ndelete from sales",
    ],
)
def test_refused_sql(sql):
    with pytest.raises(ValueError):
        adhoc.require_read_only(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "select reflect('java.lang.System', 'getProperty', 'user.dir')",
        "select `reflect`('java.lang.System', 'getProperty', 'user.dir')",
        "select reflect/**/('java.lang.System', 'getProperty', 'user.dir')",
        "select /* ' */ reflect('java.lang.System', 'getProperty', 'user.dir') /* ' */",
        "select (select max(java_method('java.lang.System', 'getProperty', store_id)) from stores)",
        "select * from sales where exists (select try_reflect('java.lang.System', 'lineSeparator'))",
        "select transform(order_id) using 'cat' from sales",
        "select transform(order_id) USING/**/'cat' as (x) from sales",
        "select * from foreign_view", "select * from default.sales", "with a as (select * from foreign_view) select * from a",
        "select * from sales where order_id in (select x from foreign_view)",
        "select spark_catalog.default.f(1)", "select no_such_function(1)", "select * from no_such_table_function(1)",
        "select input_file_name() from sales",
    ],
)
def test_refused_plans(spark, star, sql):
    spark.range(3).selectExpr("id as x").createOrReplaceTempView("foreign_view")
    with pytest.raises(ValueError):
        adhoc.query(spark, star, sql)


def test_sql_leaves_the_session_as_it_is(spark, star):
    spark.range(3).createOrReplaceTempView("sales")
    before = sorted(t.name for t in spark.catalog.listTables())
    rows = adhoc.query(
        spark,
        star,
        "with stores as (select 'mine' as store_name), b as (select count(*) as n from sales) "
        "select n, store_name, 'drop it; reflect(' as note /* update x */ from b cross join stores cross join range(1)",
    ).collect()
    assert [tuple(r) for r in rows] == [(4, "mine", "drop it; reflect(")]
    assert sorted(t.name for t in spark.catalog.listTables()) == before
    assert spark.table("sales").count() == 3
    spark.catalog.dropTempView("sales")


@pytest.mark.parametrize(
    "sql",
    [
        "select 'drop table x; ' as a", "SELECT last_update from (select 1 as last_update);",
        "with a as (select 1 as b) select b from a", "select replace('a', 'b', 'c')",
        'select 1 as `x`', "select transform(array(1), x -> x + 1)",
    ],
)
def test_accepted_sql(sql):
    assert adhoc.require_read_only(sql)


def test_sql_over_registered_tables(spark, star):
    rows = adhoc.query(
        spark, star, "SELECT st.store_name, SUM(s.amount) AS a FROM sales s JOIN stores st USING (store_id) GROUP BY 1;"
    )
    assert {r.store_name: float(r.a) for r in rows.collect()} == {
        "Corner Soup": 76.0, "Harbour Poke": 1038.5, "Night Grill": 66.0,
    }


def test_sql_cannot_read_files(spark, star):
    with pytest.raises(ValueError, match="not a table"):
        adhoc.query(spark, star, "select * from parquet.`/root/testdata/sf0.001/region.parquet`").collect()


def test_numbers_are_dense_and_ordered(spark):
    equal = spark.range(4000).select(F.lit(7).alias("k"), (F.col("id") % 3).alias("v"))
    mixed = equal.unionAll(spark.range(1000).select((F.col("id") % 11).cast("int"), F.col("id")))
    rows = numbering.number_rows(mixed, ["k", "v"]).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 5001))
    assert [(r.k, r.v) for r in rows] == sorted((r.k, r.v) for r in rows)


def test_pieces_of_a_long_text_are_spread_and_complete(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(20_000))
    df = spark.createDataFrame([("long", text), ("short", "abc"), ("none", "")], "target string, bare string")
    lengths = F.array(*[F.lit(n) for n in (0, 2, 5, 9, 3)])
    pieces = resolve._pieces(df, "bare", lengths)
    expected = {(t, v[i : i + n]) for t, v in (("long", text), ("short", "abc"), ("none", "")) for n in (0, 2, 5, 9, 3) if n <= len(v) for i in range(max(1, len(v) - n + 1))}
    rows = [tuple(r) for r in pieces.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    names = spark.createDataFrame([(text[4090:4110],), (text[19_990:],)], "name string")
    found = resolve.resolve_names(df.select("bare"), names, "name").where(F.length("input") > 1000).collect()
    assert [r.resolved for r in found] == [text[4090:4110]]
