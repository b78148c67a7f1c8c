from conftest import rows_of

from tidemark.operators import changes
from tidemark.sources import tables

RAW = "topic string, op string, before map<string,string>, after map<string,string>, seq bigint"
RULES = "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, " \
        "sinkPk string, sinkExtend string, version int"


def envelopes(spark):
    image = {"id": "1", "name": "n", "x": "y"}
    return changes.normalise_changes(spark.createDataFrame([
        ("srv.db.user", "CREATE", None, image, 1),
        ("srv.db.user", "READ", None, {**image, "name": "m"}, 2),
        ("srv.db.user", "UPDATE", image, {**image, "name": "o"}, 3),
        ("srv.db.user", "DELETE", image, None, 4),
        ("srv.db.other", "CREATE", None, image, 5),
        ("srv.db.order", "CREATE", None, image, 6),
        ("srv.db.order", "UPDATE", None, image, 7),
    ], RAW))


def rules(spark):
    return changes.current_rules(spark.createDataFrame([
        ("user", "insert", "hbase", "old_name", "id", "id", None, 1),
        ("user", "insert", "hbase", "dim_user", "id,name", None, None, 2),
        ("user", "update", "hbase", "dim_user", "id,name", None, "", 1),
        ("order", "insert", "kafka", "dwd_order", "id, name", "id", None, 1),
        ("order", "update", "clickhouse", "stats", "id", "id", None, 1),
    ], RULES), ["version"])


def test_envelope(spark):
    rows = envelopes(spark).orderBy("seq").collect()
    assert [r.type for r in rows[:4]] == ["insert", "insert", "update", "delete"]
    assert (rows[0].database, rows[0].tableName) == ("db", "user")
    assert rows[0].before == {} and rows[3].after == {}


def test_deletes_are_dropped_and_unknown_types_kept(spark):
    rows = spark.createDataFrame([("delete",), ("insert",), (None,)], "type string")
    assert changes.drop_deletes(rows).count() == 2


def test_last_rule_stands_and_defaults_are_filled(spark):
    rule = rules(spark).where("sourceTable = 'user' and operateType = 'insert'").collect()
    assert [(r.sinkTable, r.sinkPk, r.sinkExtend) for r in rule] == [("dim_user", "id", "")]


def test_routing(spark):
    routed = changes.route_changes(changes.drop_deletes(envelopes(spark)), rules(spark))
    assert sorted(r.seq for r in routed.collect()) == [1, 2, 3, 6, 7]
    assert [r.seq for r in changes.to_topics(routed).collect()] == [6]
    assert sorted(r.seq for r in changes.to_dimensions(routed).collect()) == [1, 2, 3]
    assert [r.seq for r in changes.unrouted(routed).collect()] == [7]


def test_columns_are_cut_by_exact_name(spark):
    routed = changes.route_changes(changes.drop_deletes(envelopes(spark)), rules(spark))
    after = {r.seq: r.after for r in routed.collect()}
    assert after[1] == {"id": "1", "name": "n"}
    assert after[6] == {"id": "1"}  # ' name' with a blank is another name


def test_messages_and_dimensions(spark):
    routed = changes.route_changes(changes.drop_deletes(envelopes(spark)), rules(spark))
    assert [tuple(r) for r in changes.topic_messages(routed).collect()] == [("dwd_order", '{"id":"1"}')]
    latest = changes.latest_dimensions(changes.dimension_changes(routed))
    assert [(r.pk, r.seq, r.after["name"]) for r in latest.collect()] == [("1", 3, "o")]
    table = changes.dimension_table(latest, "dim_user", ["id", "name"])
    assert [tuple(r) for r in table.collect()] == [("1", "o")]


def test_stored_dimensions_resolve_to_the_newest_and_survive_a_retry(spark, scratch):
    path, compacted = scratch("dims"), scratch("compact")
    routed = changes.route_changes(changes.drop_deletes(envelopes(spark)), rules(spark))
    rows = changes.dimension_changes(routed)
    write = tables.batch_writer(path, ["sinkTable"])
    write(rows.where("seq <= 2"), 0)
    write(rows.where("seq > 2"), 1)
    write(rows.where("seq > 2"), 1)
    assert spark.read.parquet(path).count() == 3
    assert [r.seq for r in tables.read_dimensions(spark, path).collect()] == [3]
    tables.compact_dimensions(spark, path, compacted)
    kept = spark.read.parquet(compacted)
    assert rows_of(kept.select("pk", "seq")) == rows_of(tables.read_dimensions(spark, path).select("pk", "seq"))


def test_compacted_rows_and_later_changes_equal_the_whole_history(spark, scratch):
    path, compacted = scratch("dims"), scratch("compact")
    schema = "sinkTable string, pk string, after map<string,string>, seq bigint"
    write = tables.batch_writer(path, ["sinkTable"])
    for batch in range(4):
        rows = [("t", str(n % 5), {"v": str(batch)}, batch * 10 + n) for n in range(batch, 8)]
        write(spark.createDataFrame(rows, schema), batch)
        if batch == 1:
            tables.compact_dimensions(spark, path, compacted)
        if batch == 2:
            tables.compact_dimensions(spark, path, compacted, compacted)
        if batch:
            both = tables.read_dimensions(spark, path, compacted).select("pk", "seq", "after.v")
            assert rows_of(both) == rows_of(tables.read_dimensions(spark, path).select("pk", "seq", "after.v"))
