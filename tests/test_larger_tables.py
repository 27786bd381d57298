"""Queries on tables with the keys and shapes that larger copies have, against their SQL."""

import datetime
import decimal
from collections import Counter

import duckdb

from saldo.catalogue import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.date | datetime.datetime) else v


def assert_same(spark, folder, name, **tables):
    """The query over the tables, which are given as SQL, has the rows that its own SQL has."""
    with duckdb.connect() as duck:
        duck.execute("SET TimeZone = 'UTC'")
        for table, sql in tables.items():
            duck.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
            duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        found = duck.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        want = Counter(tuple(map(plain, r)) for r in found.fetchall())
    have = Counter(tuple(map(plain, r)) for r in QUERIES[name](spark, str(folder)).select(*[f"`{c}`" for c in columns]).collect())
    assert want and have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


def test_candidates_of_parts_with_more_digits(spark, tmp_path):
    lines = "SELECT * FROM (VALUES (1, 1, 200000, 5, 'R', 'F'), (1, 2, 1, 1, 'R', 'O'), (2, 1, 900000, 70000, 'N', 'F'), (2, 3, 4, 4, 'A', 'O')) AS v(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus)"
    lines = lines.replace("SELECT *", "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_returnflag, l_linestatus")
    assert_same(spark, tmp_path, "candidate_choice", lineitem=lines)


def test_platforms_of_keys_that_begin_like_a_mark(spark, tmp_path):
    assert_same(spark, tmp_path, "platform_ladder", supplier="SELECT s_suppkey FROM range(16870, 16900) AS r(s_suppkey) UNION ALL SELECT unnest([1687::BIGINT, 1688, 1689, 1690, 168803])")


def uses(df, function):
    """How often a function stands in the plan as it is written."""
    return df._jdf.queryExecution().analyzed().toString().count(f"{function}(")


def test_reading_a_cell_stays_small(spark):
    """What reads a cell is written out once, not once for each use: of each of these there were dozens."""
    from saldo.functions import text

    rows = spark.createDataFrame([("1",)], "v string")
    number, date = rows.select(text.parse_number("v").alias("n")), rows.select(text.parse_date("v").alias("d"))
    assert uses(number, "translate") == 1 and uses(date, "substring_index") <= 2


def test_canonical_reads_a_day_once(spark):
    from saldo.operators import normalise

    names = "order_id sku paid_amount refund_amount business_date campaign entity_type spend_amount row_no quantity unit_cost tracking_number freight_amount".split()
    rows = spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
    for kind in (normalise.orders(), normalise.advertising(), normalise.cost("2024-05"), normalise.freight(), normalise.order_freight()):
        # Twice for each day: by its own column, and twice more where the key is made of it.
        assert uses(normalise.canonical(rows, kind), "substring_index") <= 6, kind.dataset


def test_profiles_and_gaps_read_a_cell_once(spark):
    from saldo.operators import profile

    rows = spark.createDataFrame([("A", "1", "2")], "g string, marker string, paid string")
    assert uses(profile.total_gaps(rows, "marker", ["paid"], ["g"]), "translate") == 1
    assert uses(profile.profile(rows, ["paid"]), "substring_index") <= 2


def test_cells_read_as_before(spark):
    from saldo.functions import text

    numbers = {"12": 12, " 1e3": 1000, "(5)": -5, "(-5)": 5, "（7%）": -0.07, "¥1,234.50元": 1234.5, "5%": 0.05, "2.00005": 2.0001, "--5": None, "x": None, "": None, "２.５": 2.5, "1 2": 12}
    dates = {"2024-05-03": "2024-05-03", "2024-05-03 23:59": "2024-05-03", "2024-02-30": None, "2024-05-03\n": "2024-05-03", "1999/1/2 3:04": "1999-01-02", "20240503": "2024-05-03", "45000.5": "2023-03-15", "20x5-1-2": None, "2024年5月3日": "2024-05-03", "2024-05-03T10:00:00+08:00": "2024-05-03", "12.5": None, "": None}
    rows = spark.createDataFrame([(v,) for v in {*numbers, *dates}], "v string").select("v", text.parse_number("v").alias("n"), text.parse_date("v").alias("d"))
    got = {r["v"]: r for r in rows.collect()}
    assert {v: None if got[v]["n"] is None else float(got[v]["n"]) for v in numbers} == numbers
    assert {v: got[v]["d"] and got[v]["d"].isoformat() for v in dates} == dates


def test_entries_are_made_in_compiled_code(spark, sf_dir):
    """Entries without a condition's rows are left out behind the explode: the function that drops them before is not compiled."""
    for name in ("certified_profit", "profit_by_part_month", "contract_of_orders"):
        assert uses(QUERIES[name](spark, sf_dir), "array_compact") == 0, name


def test_a_fact_touches_its_own_sum_only(spark):
    from saldo.operators import statement

    facts = spark.createDataFrame([("s", "a", "it's", "1"), ("s", "a", "b\\'", "2"), ("s", None, "it's", "4"), ("s", "a", "other", "8"), ("s", "b", "it's", None)], "store string, sku string, m string, v string")
    told = statement.certified(facts, ["store"], "sku", "m", "v", ["it's", "b\\'"])
    got = {r["sku_key"]: (r["it's"], r["b\\'"], r["missing"]) for r in told.select("sku_key", "`it's`", "`b\\'`", "missing").collect()}
    assert got == {"a": (1, 2, ""), "b": (0, None, "b\\'"), "__unassigned__": (4, None, "b\\'"), "__store_total__": (5, 2, "")}
    assert told._jdf.queryExecution().analyzed().toString().count("FILTER (WHERE") == 2


def test_facts_of_one_metric_are_not_one_tasks(spark, sf_dir):
    plan = QUERIES["claimed_facts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_joins_its_rows_once(spark):
    """The rows are neither made distinct nor joined a second time, and what holds is what trying every version gives."""
    import random

    from saldo.operators import asof

    pick = random.Random(6)
    day = [None, *(datetime.date(2024, 5, d) for d in range(1, 13))]
    rows = [(i, pick.choice("abcd"), pick.choice(day)) for i in range(300)] + [(300, None, day[3])]
    versions = [(pick.choice("abc"), pick.choice(day), pick.choice(day), pick.choice([1, 2, None])) for _ in range(25)] + [(None, day[1], None, 9), ("c", day[2], day[2], 9)]
    lines = spark.createDataFrame(rows, "i int, k string, at date")
    out = asof.interval(lines, spark.createDataFrame(versions, "k string, since date, until date, v int"), "k", "at", "since", "until", "v")
    assert out.columns == ["i", "k", "at", "v", "status"] and plan_of(out).count("Scan ExistingRDD[i#") == 1 and "ShuffledHashJoin" in plan_of(out)
    got = {r["i"]: (r["v"], r["status"]) for r in out.collect()}
    want = {}
    for i, k, at in rows:
        held = [v for vk, a, b, v in versions if None not in (k, at, vk, a) and vk == k and a <= at and (b is None or at < b)]
        want[i] = (None, "absent") if not held else (None, "overlapping") if len(held) > 1 else (held[0], "found")
    assert got == want and len({s for _, s in want.values()}) == 3


def test_parts_of_orders_shuffle_lines_once(spark, sf_dir):
    plan = plan_of(QUERIES["order_branches"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") <= 2


def test_largest_part_is_rounded_as_its_sql_rounds_it(spark, tmp_path):
    """A third of 7.4999 is 2.49996666, so 2; as a part of four decimals it is 2.5000."""
    orders = "SELECT * FROM (VALUES (1::BIGINT, 1.50007::DOUBLE), (2, 7.4999), (5, 2.4999), (7, 10.0)) AS v(o_orderkey, o_totalprice)"
    lines = "SELECT o::BIGINT AS l_orderkey, n::INT AS l_linenumber, n::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1.0 * n::DOUBLE AS l_quantity, p::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'R' AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1996-01-01' AS l_shipdate FROM (VALUES (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1), (5, 1, 3), (5, 2, 1), (7, 1, 1), (7, 2, 1)) AS v(o, n, p)"
    assert_same(spark, tmp_path, "order_branches", orders=orders, lineitem=lines)


def test_assignments_look_at_days_of_change_only(spark):
    import random

    from saldo.operators import periods

    pick = random.Random(7)
    day = lambda d: datetime.date(2024, 4, 20) + datetime.timedelta(d)
    rows = [(200, "a", "1", 1, "active", day(0), day(24)), (200, "b", "1", 1, "active", day(25), day(60))]
    for p in [None, *range(150)]:
        for _ in range(pick.randrange(1, 5)):
            since = pick.choice([0, 0, 11, 14, 25])
            rows.append((p, pick.choice("ab"), pick.choice(["0.5", "1.0", "1"]), pick.choice([0, 1]), pick.choice(["active", "active", "active", "conflict"]), day(since), day(pick.choice([since, since + 3, 24, 60, 60]))))
    df = spark.createDataFrame(rows, "product int, person string, ratio string, tier int, status string, since date, until date")
    out = periods.assignments(df, "2024-05-01", "2024-05-31")
    want = {}
    for p in {r[0] for r in rows}:
        signs, fault = set(), None
        mine = [r for r in rows if r[0] == p and r[6] >= day(11) and r[5] <= day(41)]
        for d in map(day, range(11, 42)):
            on = [r for r in mine if r[5] <= d <= r[6]]
            on = [r for r in on if r[3] == max(x[3] for x in on)]
            active = [r for r in on if r[4] == "active"]
            if not on:
                fault = fault or ("missing", d)
            elif len(active) < len(on) or len({r[1] for r in active}) < len(active):
                fault = fault or ("conflict", d)
            elif sum(float(r[2]) for r in active) != 1:
                fault = fault or ("ratio", d)
            signs.add(tuple(sorted((r[1], float(r[2])) for r in active)))
        if mine:
            want[p] = fault or ("split" if len(signs) > 1 else "ok", None)
    assert {r["product"]: (r["status"], r["failed_on"]) for r in out.collect()} == want
    assert set(s for s, _ in want.values()) == {"missing", "conflict", "ratio", "split", "ok"} and uses(out, "sequence") == 0


def test_orphan_majors_never_deal_rows_by_category(spark, monkeypatch):
    from saldo.operators import audit

    rows = spark.createDataFrame([(1, "p", "x", 1), (1, "p", "x", 1), (2, "p", "y", 2), (3, "q", "x", 4), (4, None, "y", 8), (5, "q", "z", 16), (6, "q", None, 32)], "i int, platform string, major string, v int")
    metrics = spark.createDataFrame([("p", "y"), ("q", "x"), ("r", "x")], "platform string, major string")
    for most in (100_000, 2):
        monkeypatch.setattr(audit, "MOST_BROADCAST", most, raising=False)
        out = audit.orphan_majors(rows, metrics, "platform", "major", "v", ["i"])
        if most > 2:
            assert plan_of(out).count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan_of(out)
        assert {(r["platform"], r["major"]): (r["rows"], r["amount"]) for r in out.collect()} == {("p", "x"): (1, 1), (None, "y"): (1, 8)}, most


def rows_shuffled(spark, run):
    """Rows that all stages of a run write for other tasks."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    run()
    return sum(n for s, n in written().items() if s not in before)


def test_facts_of_a_profit_are_not_dealt_by_order(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    told = QUERIES["certified_profit"](spark, sf_dir)
    n = rows_shuffled(spark, lambda: told.write.format("noop").mode("overwrite").save())
    assert lines < n < 3 * lines, (n, lines)
