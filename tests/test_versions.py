import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardledger.operators import stock as S
from wardledger.plans import table_jobs as J
from wardledger.sources.schemas import SCHEMAS, STOCK_STATE
from wardledger.sources.versions import StaleBaseError, VersionedTable

SCHEMA = "name string, month string, v int"


@pytest.fixture
def stored(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return VersionedTable(spark, str(tmp_path / "t"), schema, F.col("month"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_upsert_rewrites_touched_partitions_only(spark, stored):
    assert stored.version() == 0 and rows(stored.read()) == []
    first = [("a", "1", 1), ("b", "1", 2), ("c", "2", 3), ("d", "3", 4), (None, "3", 5)]
    assert stored.replace(frame(spark, *first), "load") == 1
    assert rows(stored.read()) == sorted(first, key=str)
    # b changes, c moves to another month and leaves its own empty, e is new, the row without a name goes
    changes = frame(spark, ("b", "1", 20), ("c", "1", 30), ("e", "4", 50))
    gone = spark.createDataFrame([(None,)], "name string")
    assert stored.upsert(changes, ["name"], "job", deleted=gone) == 2
    now = [("a", "1", 1), ("b", "1", 20), ("c", "1", 30), ("d", "3", 4), ("e", "4", 50)]
    assert rows(stored.read()) == sorted(now, key=str)
    assert rows(stored.read(1)) == sorted(first, key=str)
    parts = stored._manifest(2)["parts"]
    assert set(parts) == {"_part=1", "_part=3", "_part=4"}
    more = stored.upsert(frame(spark, ("a", "1", 9)), ["name"], "again")
    kept = stored._manifest(more)["parts"]
    assert kept["_part=3"] == parts["_part=3"] and kept["_part=4"] == parts["_part=4"] and kept["_part=1"] != parts["_part=1"]


def test_a_rerun_changes_nothing(spark, stored):
    stored.replace(frame(spark, ("a", "1", 1)), "load")
    for _ in range(2):
        assert stored.upsert(frame(spark, ("a", "1", 2)), ["name"], "job") == 2
    assert stored.version() == 2 and rows(stored.read()) == [("a", "1", 2)]
    assert stored.upsert(frame(spark, ("z", "1", 2)), ["name"], "load") == 1 and stored.version() == 2


def test_a_killed_job_leaves_the_table_as_it_was(spark, stored, monkeypatch):
    stored.replace(frame(spark, ("a", "1", 1), ("b", "2", 2)), "load")
    monkeypatch.setattr(VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        stored.upsert(frame(spark, ("a", "1", 7)), ["name"], "job")
    monkeypatch.undo()
    assert stored.version() == 1 and rows(stored.read()) == [("a", "1", 1), ("b", "2", 2)]
    assert stored.upsert(frame(spark, ("a", "1", 7)), ["name"], "job") == 2  # the same job, run again
    assert rows(stored.read()) == [("a", "1", 7), ("b", "2", 2)]


def test_the_base_must_not_have_moved(spark, stored):
    stored.replace(frame(spark, ("a", "1", 1)), "load")
    base = stored.version()
    stored.upsert(frame(spark, ("a", "1", 2)), ["name"], "one", base=base)
    with pytest.raises(StaleBaseError):
        stored.upsert(frame(spark, ("a", "1", 3)), ["name"], "two", base=base)
    assert rows(stored.read()) == [("a", "1", 2)]


def test_folio_counters_are_kept_up(spark, table, tmp_path):
    counters = table("folio_counter", {"company": "A", "claim_year": 2023, "claim_month": 5, "folio_no": 7}, {"company": "Z", "claim_year": 2020, "claim_month": 1, "folio_no": 3})
    kept = VersionedTable(spark, str(tmp_path / "counters"), counters.schema, F.col("claim_year"))
    kept.replace(counters, "load")
    heads = "name string, company string, claim_year int, claim_month int, creation timestamp_ntz"
    headers = spark.createDataFrame([("c1", "A", 2023, 5, None), ("c2", "A", 2023, 5, None), ("c3", "B", 2023, 6, None)], heads)
    for _ in range(2):  # a second run of the same job counts nothing twice
        J.save_folio_counters(kept, headers, "numbers of 2023-06-01")
    assert {(r.company, r.claim_month): r.folio_no for r in kept.read().collect()} == {("A", 5): 9, ("B", 6): 1, ("Z", 1): 3}
    assert kept._manifest(2)["parts"]["_part=2020"] == kept._manifest(1)["parts"]["_part=2020"]


def test_links_and_originals_are_saved_once(spark, table, tmp_path):
    appointments = table(
        "patient_appointment",
        {"name": "A1", "nhif_patient_claim": "c1"}, {"name": "A2", "nhif_patient_claim": ""}, {"name": "A3", "nhif_patient_claim": "other"},
    )
    claims = table("insurance_claim", {"name": "c1", "patient_appointment": "A2"})
    kept = VersionedTable(spark, str(tmp_path / "appointments"), appointments.schema, F.substring("name", 2, 1))
    kept.replace(appointments, "load")
    for _ in range(2):
        assert J.save_appointment_links(kept, claims, "links") == 2
    assert {r.name: r.nhif_patient_claim for r in kept.read().collect()} == {"A1": "", "A2": "c1", "A3": "other"}
    assert kept._manifest(2)["parts"]["_part=3"] == kept._manifest(1)["parts"]["_part=3"]
    assert J.save_deleted_claims(kept, claims, "deleted") == 3
    assert {r.name: r.nhif_patient_claim for r in kept.read().collect()}["A2"] == ""

    items = table("claim_item", {"name": "i1", "parent": "c1", "ref_docname": "x"}, {"name": "i2", "parent": "c1", "ref_docname": "y"})
    originals = VersionedTable(spark, str(tmp_path / "originals"), SCHEMAS["original_claim_item"], F.col("parent"))
    J.save_original_snapshot(originals, items.filter("name = 'i1'"), "first save")
    for _ in range(2):
        J.save_missing_originals(originals, items, "top up")
    assert sorted(r.ref_docname for r in originals.read().collect()) == ["x", "y"]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_stock_equals_the_whole_ledger(spark, tables, tmp_path, seed):
    r = random.Random(seed)
    start = dt.datetime(2023, 1, 1)
    ledger: dict[str, dict] = {}
    kept = VersionedTable(spark, str(tmp_path / "stock"), STOCK_STATE, F.col("warehouse"))

    def post(hour, cancelled=0, item=None, warehouse=None):
        name = f"s{len(ledger):04d}"
        ledger[name] = {
            "name": name, "item_code": item or r.choice(["a", "b", "c", None]), "warehouse": warehouse or r.choice(["w1", "w2"]),
            "qty_after_transaction": r.choice([None, 1.5, 4.0, 9.0]), "is_cancelled": cancelled,
            "creation": r.choice([start + dt.timedelta(hours=hour)] * 5 + [None]),
        }

    for run in range(4):
        for _ in range(8):
            post(24 * run + r.randrange(3))
        if run % 2:  # an entry made long ago is cancelled, which adds one that is cancelled itself
            old = r.choice([e for e in ledger.values() if not e["is_cancelled"]])
            old["is_cancelled"] = 1
            post(24 * run + 3, 1, old["item_code"], old["warehouse"])
            list(ledger.values())[-1].update(creation=start + dt.timedelta(hours=24 * run + 3), item_code=old["item_code"])
        t = tables(stock_ledger_entry=list(ledger.values()))
        for _ in range(2):  # a rerun changes nothing
            assert J.save_stock_state(kept, t, f"run {run}") == run + 1
        assert rows(S.stock_of_state(kept.read())) == rows(S.stock_on_hand(t))


def test_only_new_ledger_rows_are_scanned(spark, table, tables, tmp_path):
    entry = {"item_code": "a", "warehouse": "w", "is_cancelled": 0, "qty_after_transaction": 1.0}
    old = tables(stock_ledger_entry=[{**entry, "name": "s1", "creation": dt.datetime(2023, 1, 1)}])
    kept = VersionedTable(spark, str(tmp_path / "stock"), STOCK_STATE, F.col("warehouse"))
    J.save_stock_state(kept, old, "first")
    # the first day's rows are no longer there, so reading them would lose the item
    later = [{**entry, "name": "s2", "item_code": "b", "creation": dt.datetime(2023, 1, 2), "qty_after_transaction": 7.0}]
    J.save_stock_state(kept, tables(stock_ledger_entry=later), "second")
    assert rows(S.stock_of_state(kept.read())) == [("a", "w", 1.0), ("b", "w", 7.0)]
