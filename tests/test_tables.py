"""Sinks, ids, splits, tickets and the intake stream."""

import datetime as dt

from brightloom import config as C
from brightloom.operators import ranking, splits
from brightloom.queries.dispatch import raw_tickets
from brightloom.session import fresh_path
from brightloom.sources import tables, tickets
from brightloom.streaming.intake import Intake


def test_versions(spark):
    path = fresh_path(spark, "t")
    tables.overwrite(spark.range(5), path, 1)
    tables.overwrite(tables.read_latest(spark, path).filter("id > 2"), path, 2)
    assert sorted(r.id for r in tables.read_latest(spark, path).collect()) == [3, 4]


def test_keyed_update_touches_only_its_rows(spark):
    now = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, 30)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 21), (9, "z", 0)], "id int, s string, n int")
    got = sorted(map(tuple, tables.keyed_update(now, new, "id", ["s", "n"]).collect()))
    assert got == [(1, "a", 10), (2, None, 21), (3, None, 30)]


def test_ids_start_at_the_floor_or_after_the_highest(spark):
    batch = spark.createDataFrame([(k,) for k in (5, 250_000, 17, 100_001)], "k long")
    empty = spark.createDataFrame([], "i long")
    got = {r.k: r.new_id for r in ranking.next_ids(batch, empty, "i", "k", C.FIRST_FREE_ID).collect()}
    assert got == {5: 200_000_001, 17: 200_000_002, 100_001: 200_000_003, 250_000: 200_000_004}
    taken = spark.createDataFrame([(41,)], "i long")
    assert min(r.new_id for r in ranking.next_ids(batch, taken, "i", "k", C.FIRST_FREE_ID).collect()) == 42


def test_positions_with_nulls_in_the_group(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "g") for i in range(100)], "k long, g string")
    got = ranking.positions(rows, ["k"], "floor(k / 7)", ["g"]).collect()
    assert sorted((str(r.g), r.position) for r in got) == sorted((s, p) for s in ("None", "g") for p in range(1, 51))
    assert {r.group_size for r in got} == {50}


def test_split_shares(spark):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS y")
    got = splits.stratified_split(rows, "y", "id", buckets=16).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in got} == {
        (0, "test"): 180, (0, "validation"): 90, (0, "train"): 630, (1, "test"): 20, (1, "validation"): 10, (1, "train"): 70
    }
    again = splits.stratified_split(rows.repartition(7), "y", "id", buckets=16)
    assert again.exceptAll(splits.stratified_split(rows, "y", "id", buckets=16)).isEmpty()


RAW = """ticket_key long, ticket_type string, order_type string, priority string, required_skill string, street string, city string, state string,
 postal_code string, customer_latitude string, customer_longitude string, appointment_start string, appointment_end string, duration_min string"""


def ticket(key, **changes):
    row = dict(ticket_key=key, ticket_type="Order", order_type="repair", priority="High", required_skill="A", street="1 Main", city="X", state="NJ",
               postal_code="123", customer_latitude="40.0", customer_longitude="-75.0", appointment_start="2024-05-01T09:30", appointment_end="2024-05-01T10:30", duration_min="60")
    row.update(changes)
    return tuple(row.values())


def test_all_errors_of_a_ticket(spark):
    bad = ticket(1, city=" ", customer_latitude="x", appointment_start="bad")
    ok, rejected = tickets.split_valid(spark.createDataFrame([bad, ticket(2)], RAW))
    assert [r.ticket_key for r in ok.collect()] == [2]
    assert rejected.first().errors == ["City is required", "Invalid latitude/longitude", "Invalid date/time format (use YYYY-MM-DDTHH:MM)"]
    typed = tickets.typed_tickets(ok, "ticket_key")
    assert [f.name for f in typed.schema.fields] == [f.name for f in tickets.DISPATCH_SCHEMA.fields]
    assert [f.dataType for f in typed.schema.fields] == [f.dataType for f in tickets.DISPATCH_SCHEMA.fields]
    r = typed.first()
    assert r.Status == "pending" and r.Optimization_status == "Pending" and r.Optimized_score is None and r.Postal_code == 123


def intake(spark, path):
    cal = [(i, dt.date(2024, 5, 1), 1) for i in range(4)]
    tech = [(i, f"T{i}", "AB"[i % 2], "X", "NJ", 40.0 + i / 10, -75.0, 5, i) for i in range(4)]
    return Intake(
        path,
        lambda s: s.createDataFrame(cal, "technician_id long, date date, available int"),
        lambda s: s.createDataFrame(tech, "technician_id long, name string, primary_skill string, city string, state string, latitude double, longitude double, workload_capacity long, current_assignments long"),
    )


def test_stream_in_two_batches_and_again(spark):
    root = fresh_path(spark, "in")
    run = intake(spark, fresh_path(spark, "out"))
    checkpoint = fresh_path(spark, "cp")

    def drain():
        raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(root)
        run.start(raw, checkpoint).awaitTermination()
        return spark.read.parquet(run.tickets), spark.read.parquet(run.rejects)

    first = [ticket(1), ticket(2, required_skill="B"), ticket(3, street=""), ticket(4, appointment_start="2024-05-03T09:00")]
    spark.createDataFrame(first, RAW).coalesce(1).write.mode("append").parquet(root)
    drain()
    spark.createDataFrame([ticket(5), ticket(5)], RAW).coalesce(1).write.mode("append").parquet(root)
    done, rejected = drain()
    rows = {r.Dispatch_id: r for r in done.collect()}
    assert sorted(rows) == [200_000_001, 200_000_002, 200_000_003, 200_000_004]
    assert rows[200_000_001].Optimized_technician_id == "0" and rows[200_000_002].Optimized_technician_id == "1"
    none = rows[200_000_003]  # no calendar on its day
    assert none.Optimized_technician_id is None and none.Optimization_reason == "No feasible technicians found" and none.Optimization_status == "Complete"
    assert rows[200_000_004].batch == 1 and "Final Recommendation" in rows[200_000_004].explanation
    assert sorted(r.errors[0] for r in rejected.collect()) == ["Street is required", "another ticket of the batch has this key"]
    # a restart finds nothing new; a repeated batch writes the same rows again
    drain()
    run.run_batch(spark.createDataFrame([ticket(5), ticket(5)], RAW), 1)
    assert sorted(r.Dispatch_id for r in spark.read.parquet(run.tickets).collect()) == sorted(rows)


def test_raw_tickets_cover_all_orders(spark, sf_dir):
    assert raw_tickets(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_a_known_ticket_is_updated(spark):
    run = intake(spark, fresh_path(spark, "out"))
    run.run_batch(spark.createDataFrame([ticket(1), ticket(2)], RAW), 0)
    second = [ticket(1, required_skill="B"), ticket(3), ticket(2, city="Y"), ticket(2, city="Z"), ticket(1, city="")]
    for _ in range(2):
        run.run_batch(spark.createDataFrame(second, RAW), 1)
        rows = {r.Dispatch_id: r for r in run.current(spark).collect()}
        assert run.current(spark).count() == 3 and sorted(rows) == [200_000_001, 200_000_002, 200_000_003]
        assert rows[200_000_001].Required_skill == "B" and rows[200_000_001].Optimized_technician_id == "1"
        assert rows[200_000_002].City == "Y" and [rows[200_000_000 + k].batch for k in (1, 2, 3)] == [1, 1, 1]
        rejected = {(r.ticket_key, *r.errors) for r in spark.read.parquet(run.rejects).collect()}
        assert rejected == {(1, "City is required"), (2, "another ticket of the batch has this key")}


def test_a_new_checkpoint_goes_on_after_the_old_one(spark):
    root = fresh_path(spark, "in")
    run = intake(spark, fresh_path(spark, "out"))
    spark.createDataFrame([ticket(1), ticket(2)], RAW).coalesce(1).write.mode("append").parquet(root)
    for name, more in (("cp1", None), ("cp2", ticket(9, required_skill="B"))):
        if more:
            spark.createDataFrame([more], RAW).coalesce(1).write.mode("append").parquet(root)
        raw = spark.readStream.schema(RAW).parquet(root)
        run.start(raw, f"{run.path}-{name}").awaitTermination()
    rows = run.current(spark).collect()
    # known tickets keep their ids although the second checkpoint sees them again, the new one follows
    assert sorted(r.Dispatch_id for r in rows) == [200_000_001, 200_000_002, 200_000_003]
    assert {r.batch for r in rows} == {1 << 32} and spark.read.parquet(run.ids).count() == 3


def test_tickets_without_a_key_are_rejected(spark):
    run = intake(spark, fresh_path(spark, "out"))
    run.run_batch(spark.createDataFrame([ticket(None), ticket(None), ticket(4), ticket(None, city="")], RAW), 0)
    assert [r.Dispatch_id for r in run.current(spark).collect()] == [200_000_001]
    errors = sorted(tuple(r.errors) for r in spark.read.parquet(run.rejects).collect())
    assert errors == [("City is required", "Ticket key is required"), ("Ticket key is required",), ("Ticket key is required",)]
