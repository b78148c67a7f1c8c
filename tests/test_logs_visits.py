import random

from conftest import ids, rows_of

from tidemark.functions import records
from tidemark.operators import logs, visits


def flags(repaired):
    return [r[1] for r in sorted(repaired.select("event_id", "common.is_new").collect())]


def test_only_the_first_claim_of_a_visitor_stands(pages):
    log = pages([(1, "a", 10, None, "1"), (2, "a", 20, None, "0"), (3, "a", 30, None, "1")])
    assert flags(logs.repair_new_flag(log, ["event_id"])) == ["1", "0", "0"]


def test_a_record_without_claim_does_not_use_it_up(pages):
    log = pages([(1, "a", 10, None, "0"), (2, "a", 20, None, "1"), (3, "b", 5, None, None)])
    assert flags(logs.repair_new_flag(log, ["event_id"])) == ["0", "1", None]


def test_claims_at_the_same_time_are_ordered_by_tie(pages):
    log = pages([(2, "a", 10, None, "1"), (1, "a", 10, None, "1")])
    assert flags(logs.repair_new_flag(log, ["event_id"])) == ["1", "0"]


def test_claims_of_one_visitor_are_not_brought_to_one_task(pages):
    log = pages([(1, "a", 10, None, "1"), (2, "a", 20, None, "1")])
    plan = logs.repair_new_flag(log, ["event_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_dirty_lines_are_split_from_objects(spark):
    lines = spark.createDataFrame([("{bad",), ('{"a":1}',), ("[1]",), (None,), ('{"a":"x"}',)], "value string")
    good, dirty = records.split_dirty(lines)
    assert [r[0] for r in good.collect()] == ['{"a":1}', '{"a":"x"}']
    assert dirty.count() == 3


def test_lines_are_parsed_and_tagged_in_one_pass(spark):
    values = ["{bad", '{"a":1}', "[1]", None, '{"a":"x"}', ' {"b":2}', '{"a":1', "7", '{"a":3} x']
    lines = spark.createDataFrame([(value,) for value in values], "value string")
    tagged = records.parse_or_keep(lines, "a int")
    good, dirty = records.split_dirty(lines)
    assert tagged.where("dirty is null").count() == good.count()
    found = sorted(row.dirty for row in tagged.where("dirty is not null").collect())
    assert found == sorted(row.value or "" for row in dirty.collect())
    assert sorted(row.a for row in tagged.where("dirty is null and a is not null").collect())[0] == 1


def test_start_page_and_display_logs(spark):
    lines = spark.createDataFrame(
        [
            ('{"common":{"mid":"a"},"start":{"entry":"icon","loading_time":5},"ts":1}',),
            (
                '{"common":{"mid":"a"},"page":{"page_id":"p"},"displays":'
                '[{"item":"5","item_type":"sku_id","order":1},{"item":"6","item_type":"sku_id","order":2}],"ts":2}',
            ),
            ('{"common":{"mid":"a"},"page":{"page_id":"q"},"displays":[],"ts":3}',),
        ],
        "value string",
    )
    parsed = records.parse_json(lines, "common struct<mid:string>, " + "page struct<page_id:string>, "
                                "start struct<entry:string,loading_time:bigint>, "
                                "displays array<struct<item:string,item_type:string,`order`:int>>, ts bigint")
    assert [r.ts for r in logs.start_logs(parsed).collect()] == [1]
    assert sorted((r.ts, r.kind) for r in logs.tag_logs(parsed).collect()) == [(1, "start"), (2, "page"), (3, "page")]
    assert ids(logs.page_logs(parsed), "ts") == [2, 3]
    shown = logs.display_logs(logs.page_logs(parsed)).collect()
    assert [(r.item, r.ts, r.page_id) for r in shown] == [("5", 2, "p"), ("6", 2, "p")]


HOUR = 3_600_000


def test_one_visit_per_visitor_and_day(pages):
    log = pages([(1, "a", 9 * HOUR, None, "0"), (2, "a", 17 * HOUR, None, "0"), (3, "a", 25 * HOUR, None, "0"),
                 (4, "a", 8 * HOUR, "home", "0")])
    assert ids(visits.unique_visits(log, ["event_id"])) == [1, 3]


def test_visits_by_second(pages):
    log = pages([(1, "a", 1000, None, "0"), (2, "a", 1999, None, "0"), (3, "a", 2000, None, "0")])
    assert ids(visits.unique_visits(log, ["event_id"], "second")) == [1, 3]


def test_bounce_is_left_within_the_gap(pages):
    log = pages([
        (1, "stays", 0, None, "0"), (2, "stays", 9999, "home", "0"),
        (3, "late", 0, None, "0"), (4, "late", 10000, "home", "0"),
        (5, "again", 0, None, "0"), (6, "again", 3000, None, "0"),
        (7, "inner", 0, "home", "0"),
    ])
    assert ids(visits.bounces(log, ["event_id"])) == [3, 5, 6]


def brute_force(rows, gap):
    found = []
    for mid in {row[1] for row in rows}:
        own = sorted((row for row in rows if row[1] == mid), key=lambda row: (row[2], row[0]))
        for page, following in zip(own, [*own[1:], None]):
            if page[3] is None and not (following and following[3] and following[2] - page[2] < gap):
                found.append(page[0])
    return sorted(found)


def random_pages(count, mids, span, seed):
    rng = random.Random(seed)
    # One visitor holds a third of all pages.
    return [
        (n, "hot" if rng.random() < 0.34 else f"m{rng.randrange(mids)}", rng.randrange(span),
         rng.choice([None, "home"]), rng.choice(["0", "1"]))
        for n in range(count)
    ]


def test_bounces_do_not_depend_on_how_time_is_cut(pages):
    rows = random_pages(600, 15, 400_000, 7)
    log = pages(rows)
    expected = brute_force(rows, 10_000)
    for chunk in (1, 10_000, 33_000, 10**9):
        assert ids(visits.bounces(log, ["event_id"], 10_000, chunk)) == expected


def test_a_busy_visitor_is_cut_by_time(pages):
    log = pages([(1, "a", 0, None, "0")])
    plan = visits.bounces(log, ["event_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(chunk_mid" in plan and ", chunk#" in plan.split("windowspecdefinition")[1]


def test_repair_against_brute_force(pages):
    rows = random_pages(500, 10, 100_000, 3)
    claims = {}
    for n, mid, ts, _, flag in rows:
        if flag == "1":
            claims[mid] = min(claims.get(mid, (ts, n)), (ts, n))
    expected = sorted(n for _, n in claims.values())
    repaired = logs.repair_new_flag(pages(rows), ["event_id"])
    assert ids(repaired.where("common.is_new = '1'")) == expected
    assert repaired.count() == len(rows)
    assert rows_of(repaired.drop("common")) == rows_of(pages(rows).drop("common"))
