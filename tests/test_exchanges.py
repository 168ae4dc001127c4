"""How often rows move where several steps work within one claim or document."""

import os

import pytest

import __spark_entry__ as entry
from wardledger.functions.joins import dealt_by
from wardledger.operators import claim_changes as G
from wardledger.operators import claim_items as C
from wardledger.operators import claim_reconcile as M
from wardledger.operators import delivery as L
from wardledger.operators import prescriptions as P
from wardledger.sources.derived import derived_tables

SF = "/root/testdata/sf0.001"


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def shuffled(spark):
    """Joins as on large tables: no side is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def item(**more):
    return {"parent": "c", "item_quantity": 1, "unit_price": 1.0, "amount_claimed": 1.0, **more}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize(
    ("name", "most"),
    [("t2_removed_originals", 2), ("t2_removed_appointments", 2), ("t3_drug_removals", 11), ("t4_unknown_prescriptions", 4),
     ("m4_missing_originals_by_name", 4), ("s9_order_dimensions", 9), ("c10_completed_diseases", 39),
     ("s12_dispensed_prescriptions", 14)],
)
def test_rows_move_once(shuffled, name, most):
    assert moves(entry.queries()[name](shuffled, SF)) <= most


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_removed_names_move_no_row_after_the_claims_lie_together(shuffled):
    t = derived_tables(shuffled, SF)
    originals = M.reconcile_items(t.original_claim_item)
    assert moves(G.removed_names(G.marked_originals(originals, t.claim_item))) == 2
    assert moves(dealt_by(originals, "parent")) == moves(originals) == 1


def test_changes_of_repeated_and_unknown_claims(table):
    """An item that comes twice meets its original twice; rows without a claim are never claimed."""
    originals = table(
        "original_claim_item", item(idx=1, item_code="a", ref_docname="r"), item(idx=2, item_code="b", ref_docname="r"),
        item(idx=3, item_code="gone", ref_docname="g"), item(idx=4, item_code=None, ref_docname=None),
        item(parent=None, idx=5, item_code="a", ref_docname="n"),
    )
    items = table(
        "claim_item", item(item_code="a", amount_claimed=2.0), item(item_code="a", amount_claimed=3.0), item(item_code=""),
        item(parent=None, item_code="a", amount_claimed=9.0),
    )
    assert sorted(r.current_amount for r in G.amount_changes(originals, items).collect()) == [2.0, 3.0]
    assert sorted(r.idx for r in G.removed_originals(originals, items).collect()) == [3, 5]
    assert {(r.claim, r.reference) for r in G.seen_references(originals, items).collect()} == {("c", "r"), ("c", "")}


def test_missing_originals_by_name_keep_repeated_items(table):
    items = table(
        "claim_item", item(item_code="x", ref_docname="a,b"), item(item_code="x", ref_docname="a,b"), item(item_code="y", ref_docname="a"),
        item(item_code="z", ref_docname=None), item(parent=None, item_code="x", ref_docname="q"),
    )
    originals = table("original_claim_item", item(ref_docname="a,c"), item(parent="d", ref_docname="b"))
    got = M.missing_originals(items, originals, True)
    assert sorted(str(r.ref_docname) for r in got.collect()) == ["None", "a,b", "a,b"]
    assert got.columns == [c for c in items.columns if c not in M.IDENTITY_COLUMNS]


def test_rows_without_a_document_do_not_move_for_an_approval(shuffled, tables):
    t = tables(approval=[{"ref_doctype": "Lab Test", "ref_docname": "d", "approval_number": n} for n in ("2", "1")])
    names = ["name", "document_type", "document"]
    rows = shuffled.createDataFrame(
        [("a", "Lab Test", "d"), ("b", "Lab Test", "other"), ("c", "Lab Test", ""), ("d", "Lab Test", None), ("e", None, "d")],
        ", ".join(f"{n} string" for n in names),
    )
    found = P.with_approval(rows, t)
    assert sorted((r.name, r.approval_ref_no) for r in found.collect()) == [("a", "1"), ("b", None), ("c", None), ("d", None), ("e", None)]
    assert moves(P.with_approval(rows.filter("document is null"), t).select("name")) <= moves(found)


def test_lines_go_on_from_all_claims_of_a_name(shuffled, tables):
    """Services are numbered after the appointments of their claim's rows, in one move by claim."""
    claims = shuffled.createDataFrame([("c", "A", '["A","B"]'), ("c", "A", None), ("d", "E", "")], "name string, patient_appointment string, claim_appointment_list string")
    service = C._lines(shuffled.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "claim string, ref_docname string"), claim="claim", ref_docname="ref_docname")
    lines = C.numbered_lines(claims, service, service.filter("false"))
    assert sorted((r.claim, r.ref_docname, r.idx) for r in lines.collect()) == [("c", "x", 4), ("c", "y", 5), ("d", "z", 2)]
    assert moves(lines) <= 2


def test_a_note_is_refused_for_one_item_or_one_row(tables):
    """A note that is stored twice is refused whole if one of its encounters has no final diagnosis."""
    note = {"patient": "p", "form_sales_invoice": "i"}
    final = {"parenttype": "Patient Encounter", "parentfield": "patient_encounter_final_diagnosis", "idx": 1, "medical_code": "m"}
    t = tables(
        delivery_note=[{**note, "name": n, "reference_name": e} for n, e in (("N1", "E1"), ("N2", "E1"), ("N2", "E2"), ("N3", "E1"))],
        delivery_note_item=[{"name": f"{n}{i}", "parent": n, "item_code": i} for n, i in (("N1", "I"), ("N2", "I"), ("N3", "I"), ("N3", "J"))],
        medication=[{"name": "M", "item": "I"}], codification_table=[{**final, "parent": "E1"}],
    )
    accepted = L.accepted_items(t)
    assert [(r.name, r.drug_code, r.encounter) for r in accepted.collect()] == [("N1I", "M", "E1")]
    assert [r.medical_code for r in L.dispensed_prescriptions(accepted, t).collect()] == ["m\nNone"]


def test_a_lab_test_is_looked_up_within_its_encounter(shuffled, tables):
    test = {"ref_doctype": "Patient Encounter", "ref_docname": "E"}
    t = tables(
        lab_prescription=[{"name": n, "parent": e} for n, e in (("a", "E"), ("b", "E"), ("c", "E"), ("a", "F"), ("a", None))],
        lab_test=[{**test, "name": "1", "ref_childname": "a", "workflow_state": "Completed"}, {**test, "name": "2", "ref_childname": "a"},
                  {**test, "name": "1", "ref_childname": "b", "workflow_state": "Lab Test Requested"}, {**test, "name": "3", "ref_childname": "b", "workflow_state": "Completed"}],
    )
    found = P.with_status(P.prescriptions(t), t)
    assert sorted((r.name, str(r.parent), r.status) for r in found.collect()) == [
        ("a", "E", "Submitted"), ("a", "F", "Draft"), ("a", "None", "Draft"), ("b", "E", "Draft"), ("c", "E", "Draft")]
