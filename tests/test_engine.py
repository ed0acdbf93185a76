"""The store end to end."""

import pytest
from pyspark.sql import functions as F

from kithbase.engine import Hint, InvalidDetail, Store
from kithbase.plans.filters import And, Detail, Everything, Flags, Ids
from kithbase.plans.sorting import Sort


@pytest.fixture(scope="module")
def store(spark):
    s = Store.create(spark)
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    records = d([(i, 2) for i in range(10, 14)], "contactId long, collectionId long")
    return s.save(records, {
        "Name": d([(10, "Anders", "Zoll"), (11, "Bibi", "Arpad"), (12, None, "Carl")], "contactId long, firstName string, lastName string"),
        "PhoneNumber": d([(10, "+1 (212) 555-0100"), (11, "5551212"), (11, "5551213")], "contactId long, phoneNumber string"),
        "EmailAddress": d([(13, "X@Y.org"), (12, "c@c.org")], "contactId long, emailAddress string"),
        "Presence": d([(10, 4), (10, 1), (11, 6)], "contactId long, presenceState int"),
    })


def records(store):
    """The same store without its aggregates."""
    aggregates = store.db["contacts"].filter("collectionId = 1 AND contactId > 2")
    return Store(store.purge(aggregates.select("contactId")).db, aggregating=False)


def ids(df):
    return [r.contactId for r in df.collect()]


def test_queries(store):
    found = store.contact_ids(Detail("PhoneNumber", "phoneNumber", "212 555 0100", phone=True))  # only aggregates are shown
    assert [r.secondId for r in store.db["relationships"].join(found, found.contactId == F.col("firstId")).collect()] == [10]
    plain = records(store)
    assert ids(plain.contact_ids(Detail("PhoneNumber", "phoneNumber", "(212) 555-0100", phone=True))) == [10]
    assert ids(plain.contact_ids(Detail("Name", "firstName", "ANDERS", fixed_string=True))) == [10]
    assert ids(plain.contact_ids(Everything(), [Sort("Name", "lastName")])) == [11, 12, 10, 13]
    assert ids(plain.contact_ids(Everything(), [Sort("DisplayLabel", "displayLabelGroup")])) == [10, 11, 12, 13]
    assert ids(plain.contact_ids(Flags(0b1001))) == [10]
    rows = {r.contactId: r for r in plain.contacts(hint=Hint(types=("PhoneNumber", "DisplayLabel", "GlobalPresence"))).collect()}
    assert [p.phoneNumber for p in rows[11].PhoneNumber] == ["5551212", "5551213"] and rows[13].PhoneNumber is None
    assert {i: r.DisplayLabel[0].displayLabel for i, r in rows.items()} == {10: "Anders Zoll", 11: "Bibi Arpad", 12: "Carl", 13: "X@Y.org"}
    assert rows[10].GlobalPresence[0].presenceState == 1 and rows[10].isOnline and not rows[11].isOnline and rows[10].statusFlags == 0b101001
    assert [(r.contactId, r.exists) for r in plain.contacts_by_id([12, 99, 10], Hint(types=())).orderBy("pos").collect()] == [(12, True), (99, False), (10, True)]
    assert ids(plain.contacts(Everything(), [Sort("Name", "lastName")], Hint(types=("Name",), most=2))) == [11, 12]
    assert plain.submit(lambda s: s.contact_ids().count()).result() == 4
    assert plain.details("PhoneNumber", ["phoneNumber"]).count() == 3 and store.collections().count() == 2


def test_validation(store, spark):
    one = spark.createDataFrame([(20, 2)], "contactId long, collectionId long")
    with pytest.raises(InvalidDetail):
        store.save(one, {"Nothing": one})
    with pytest.raises(InvalidDetail):
        store.save(one, {"Name": spark.createDataFrame([(20, "a", "b"), (20, "c", "d")], "contactId long, firstName string, lastName string")})
    with pytest.raises(InvalidDetail):
        store.save(one, {"Tag": spark.createDataFrame([(20, "a", "u"), (20, "b", "u")], "contactId long, tag string, detailUri string")})
    with pytest.raises(InvalidDetail):
        store.save(one.union(spark.createDataFrame([(21, 3)], one.schema)), {})


def test_life(store, spark):
    told = []
    s = Store(records(store).db, aggregating=False, listeners=[lambda df: told.append({r.contactId: r.event for r in df.collect()})])
    one = lambda *i: spark.createDataFrame([(x,) for x in i], "contactId long")
    same, verdict = s.remove(one(10, 1))
    assert same is s and {r.contactId: r.verdict for r in verdict.collect()} == {10: "ok", 1: "self"}
    gone, _ = s.remove(one(10))
    assert ids(gone.contact_ids()) == [11, 12, 13] and told == [{10: "changed"}]
    assert ids(gone.contact_ids(Ids((10,)))) == [10] and ids(gone.undelete([10]).contact_ids()) == [10, 11, 12, 13]
    found, recording = gone.changes([2])
    assert {r.contactId: r.change for r in found.collect()} == {10: "deleted", 11: "added", 12: "added", 13: "added"}
    again = recording.save(spark.createDataFrame([(11, 2)], "contactId long, collectionId long"), {"Nickname": spark.createDataFrame([(11, "bobby")], "contactId long, nickname string")})
    left = {r.contactId: r.changeFlags for r in again.clear_change_flags([2]).db["contacts"].filter("contactId > 2").collect()}
    assert left == {11: 2, 12: 0, 13: 0}
    assert gone.purge(one(10)).db["PhoneNumber"].count() == 2
    on = s.update_presence(spark.createDataFrame([(12, 4)], "contactId long, presenceState int"), ["Presence"])
    assert ids(on.contact_ids(Flags(8))) == [10, 12]
    with pytest.raises(ValueError):
        s.update_presence(one(1), ["Name"])
    assert {r.displayLabelGroup for r in s.relabel("last").display_label_groups().collect()} == {"Z", "A", "C", "X"}
    assert ids(s.remove_collections([2]).contact_ids()) == []


def test_aggregation(store, spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    links = {r.secondId: r.firstId for r in store.db["relationships"].filter("secondId > 2").collect()}
    assert len(links) == 4 and len(set(links.values())) == 4
    assert ids(store.contact_ids(And((Detail("Name", "lastName", "Zoll"),)))) == [links[10]]
    # Two equal new records share an aggregate; a third joins the one that is there. Details come over once, with where they came from.
    twins = store.save(d([(30, 2), (31, 2), (32, 2)], "contactId long, collectionId long"), {
        "Name": d([(30, "anders", "ZOLL"), (31, "Nele", "Orth"), (32, "nele", "orth")], "contactId long, firstName string, lastName string"),
        "PhoneNumber": d([(30, "+1 (212) 555-0100", None), (31, "77", "u"), (32, "78", None)], "contactId long, phoneNumber string, detailUri string"),
        "Gender": d([(32, 2)], "contactId long, gender int"),
    })
    after = {r.secondId: r.firstId for r in twins.db["relationships"].filter("secondId > 2").collect()}
    assert after[30] == links[10] == after[10] and after[31] == after[32] and after[31] not in links.values()
    hint = Hint(types=("Name", "PhoneNumber", "Gender", "DisplayLabel"), relationships=False)
    rows = {r.contactId: r for r in twins.contacts(hint=hint).collect()}
    assert sorted(rows) == sorted(set(after.values()))
    assert [(p.phoneNumber, p.provenance, p.accessConstraints) for p in rows[links[10]].PhoneNumber] == [("+1 (212) 555-0100", f"2:10:{store.db['PhoneNumber'].filter('contactId = 10').first().detailId}", 3)]
    both = rows[after[31]]
    assert {(p.phoneNumber, p.detailUri) for p in both.PhoneNumber} == {("77", "aggregate-31:u"), ("78", None)} and both.Gender[0].gender == 2 and both.DisplayLabel[0].displayLabel == "Nele Orth" and both.hasPhoneNumber
    # An update shows in the aggregate, and a detail that goes is flagged for a sync.
    changed = twins.save(d([(31, 2)], "contactId long, collectionId long"), {"Name": d([(31, "Nele", "Orth-Berg")], "contactId long, firstName string, lastName string"), "PhoneNumber": d([(31, "79", "u")], "contactId long, phoneNumber string, detailUri string")}, mask=("Name", "PhoneNumber"))
    rows = {r.contactId: r for r in changed.contacts(hint=hint).collect()}
    assert {p.phoneNumber for p in rows[after[31]].PhoneNumber} == {"79", "78"} and rows[after[31]].Name[0].lastName == "Orth-Berg"


@pytest.fixture(scope="module")
def pair(store, spark):
    """The store with two records more, which share an aggregate."""
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    return store.save(d([(31, 2), (32, 2)], "contactId long, collectionId long"), {"Name": d([(31, "Nele", "Orth"), (32, "nele", "orth")], "contactId long, firstName string, lastName string"), "PhoneNumber": d([(31, "77"), (32, "78")], "contactId long, phoneNumber string")})


def test_aggregates_lose_constituents(pair, spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    after = {r.secondId: r.firstId for r in pair.db["relationships"].filter("secondId > 2").collect()}
    hint = Hint(types=("PhoneNumber",), relationships=False)
    # The last constituent takes the aggregate along.
    gone, _ = pair.remove(d([(31,)], "contactId long"))
    rows = {r.contactId: r for r in gone.contacts(hint=hint).collect()}
    assert [p.phoneNumber for p in rows[after[31]].PhoneNumber] == ["78"]
    gone, _ = gone.remove(d([(32,)], "contactId long"))
    assert after[31] not in ids(gone.contact_ids())
    apart = pair.remove_relationships(pair.db["relationships"].filter("secondId = 11"))
    assert after[11] not in ids(apart.contact_ids()) and ids(apart.aggregate_orphans().contact_ids(Detail("Name", "lastName", "Arpad"))) != []


def test_details(store, spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    s = records(store)
    one = d([(11, 2)], "contactId long, collectionId long")
    before = {r.phoneNumber: r.detailId for r in s.db["PhoneNumber"].filter("contactId = 11").collect()}
    s = s.clear_change_flags([2]).save(one, {"PhoneNumber": d([(11, "5551212"), (11, "5550000"), (11, "444")], "contactId long, phoneNumber string")}, mask=("PhoneNumber",))
    again = {r.phoneNumber: r.detailId for r in s.db["PhoneNumber"].filter("contactId = 11").collect()}
    assert again["5551212"] == before["5551212"] and again["5550000"] == before["5551213"] and "444" in again
    less = s.save(one, {"PhoneNumber": d([(11, "444")], "contactId long, phoneNumber string")}, mask=("PhoneNumber",))
    hint = Hint(types=("PhoneNumber",), relationships=False)
    shown = lambda x, **k: {r.contactId: r for r in x.contacts(Ids((11,)), hint=hint, **k).collect()}[11].PhoneNumber
    assert [p.phoneNumber for p in shown(less)] == ["444"] and {p.phoneNumber: p.changeFlags for p in shown(less, sync=True)} == {"5551212": 4, "5550000": 6, "444": 1}
    assert ids(less.contact_ids(Detail("PhoneNumber", "phoneNumber", "5551212"))) == []
    assert shown(less)[0].provenance == f"2:11:{again['444']}" and less.db["details"].filter("detail = 'Name' AND contactId = 11").first().changeFlags == 0
    assert less.clear_change_flags([2]).db["PhoneNumber"].filter("contactId = 11").count() == 1
    guids = {r.contactId: r.guid for r in less.db["Guid"].collect()}
    assert set(guids) >= {10, 11, 12, 13} and guids == {r.contactId: r.guid for r in store.db["Guid"].join(spark.createDataFrame([(x,) for x in guids], "contactId long"), "contactId").collect()}
    on = less.update_presence(d([(12, 4, "out")], "contactId long, presenceState int, customMessage string"), ["Presence"])
    row = on.contacts(Ids((12,)), hint=Hint(types=("GlobalPresence",))).first()
    assert row.isOnline and [(g.presenceState, g.customMessage) for g in row.GlobalPresence] == [(4, "out")]


def test_identity_collections_and_jobs(store, spark):
    assert store.identity() == 2 and store.identity(5) is None
    assert store.set_identity(5, 11).identity(5) == 11 and store.set_identity(5, 11).set_identity(5, None).identity(5) is None
    new = store.db["collections"].filter("collectionId = 2").withColumn("collectionId", F.lit(7).cast("long"))
    s = store.save_collections(new, spark.createDataFrame([(7, "k", bytearray(b"v"))], "collectionId long, key string, value binary"))
    assert {r.collectionId: r.metadata for r in s.collections().collect()}[7] == {"k": bytearray(b"v")}
    job = store.submit(lambda s: [len(b) for b in s.in_batches(s.db["contacts"], 3)])
    assert sum(job.result()) == store.db["contacts"].count() and job.progress() == (0, 0) and not job.cancel()
    failing = store.submit(lambda s: 1 / 0)
    assert isinstance(failing.exception(), ZeroDivisionError)
