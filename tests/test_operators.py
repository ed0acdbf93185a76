import pytest
from pyspark.sql import functions as F

from kithbase.operators import changes, delta, details, matching, merging, oob, relationships, sync
from kithbase.sources import schema, snapshot

# Case, whether it matches, one side, the other (first, last, nickname, gender, phone, email, account).
FULL = dict(first="Signe", last="Brightwater", nick="sbri", phone="11111", email="f@x.org", account="f@msg")
ROWS = [
    ("last name and a shared email, other first names", False, dict(first="Signe", last="G", email="e"), dict(first="Oda", last="G", email="e")),
    ("last name and all shared, other first names", False, dict(first="Signe", last="G", email="e", phone="1", account="a"), dict(first="Oda", last="G", email="e", phone="1", account="a")),
    ("same name", True, dict(first="Signe", last="Brightwater", phone="1"), dict(first="Signe", last="Brightwater", phone="2")),
    ("same name in another case", True, dict(first="Signe", last="brightwater"), dict(first="signe", last="Brightwater")),
    ("hyphens", True, dict(first="Signe-Oda", last="G"), dict(first="Signe-Oda", last="G")),
    *[(f"without {k}", True, FULL, {**FULL, k: None}) for k in ("first", "last", "nick", "phone", "email", "account")],
    ("other nickname", True, FULL, {**FULL, "nick": "other"}), ("other first name", False, FULL, {**FULL, "first": "Oda"}), ("other last name", False, FULL, {**FULL, "last": "Water"}),
    ("last name only, nothing shared", False, dict(last="Brightwater"), dict(first="Signe", last="Brightwater")),
    ("opposite genders", False, {**FULL, "gender": 1}, {**FULL, "gender": 2}), ("one gender", True, {**FULL, "gender": 1}, FULL), ("same gender", True, {**FULL, "gender": 1}, {**FULL, "gender": 1}),
    ("nickname only", True, dict(nick="fg"), dict(nick="fg")), ("nicknames differ", False, dict(nick="fg"), dict(nick="x")), ("nickname, one with a name", False, dict(nick="fg"), dict(nick="fg", first="Signe")), ("nickname, one with a last name", False, dict(nick="fg"), dict(nick="fg", last="G")),
    *[(f"last name and shared {k}", True, dict(last="Brightwater", **{k: "same"}), dict(first="Signe", last="Brightwater", **{k: "same"})) for k in ("phone", "email", "account")],
    ("part of a first name", False, dict(first="Sig", last="Brightwater"), dict(first="Sigrid", last="Brightwater")),
]


def _side(spark, swap):
    sides = []
    for k in (1, 0) if swap else (0, 1):
        people = [(i, (r[2], r[3])[k]) for i, r in enumerate(ROWS)]
        # names are made distinct by case, so that only the two sides of a row can meet
        tag = lambda v, i: None if v is None else f"{v}~{i}"
        frame = spark.createDataFrame([(i, tag(p.get("first"), i), tag(p.get("last"), i), p.get("gender")) for i, p in people], "id long, firstName string, lastName string, gender int")
        points = {kind: spark.createDataFrame([(i, tag(p[key], i)) for i, p in people if p.get(key)], "id long, value string") for kind, key in (("nickname", "nick"), ("email", "email"), ("phone", "phone"), ("account", "account"))}
        sides.append((frame, points))
    (a, pa), (b, pb) = sides
    return a, b, {k: (pa[k], pb[k]) for k in pa}


@pytest.mark.parametrize("swap", [False, True])
def test_matching(spark, swap):
    got = {r.probe_id: r.target_id for r in matching.best(matching.scores(*_side(spark, swap))).collect()}
    assert [(ROWS[i][0], i in got) for i in range(len(ROWS))] == [(r[0], r[1]) for r in ROWS]
    assert all(k == v for k, v in got.items())


def test_scores_collapse_and_exclusion(spark):
    a, b, points = _side(spark, False)
    i = next(n for n, r in enumerate(ROWS) if r[0].startswith("last name and all"))
    assert matching.scores(a, b, points).filter(f"probe_id = {i}").first() is None or matching.scores(a, b, points).filter(f"probe_id = {i}").first().score == 3
    none = spark.createDataFrame([(2, 2)], "probe_id long, target_id long")
    assert matching.scores(a, b, points, none).filter("probe_id = 2").count() == 0
    links, new = matching.attach(a, matching.best(matching.scores(a, b, points)), 500)
    assert links.count() == len(ROWS) and new.count() == sum(not r[1] for r in ROWS) and new.agg(F.min("contactId")).first()[0] == 500


def test_best_matches_by_hand(spark):
    """The best target of each probe, as scores() of all pairs have it: with exclusions, genders, blanks, and probes among themselves."""
    import numpy as np

    rng = np.random.RandomState(3)
    pick = lambda *a: a[rng.randint(len(a))]
    people = lambda ids: spark.createDataFrame([(i, pick(None, "", "Mira", "mira", "Tobe"), pick(None, "Orth", "orth", "Lund"), int(rng.randint(3))) for i in ids], "id long, firstName string, lastName string, gender int")
    probes, targets = people(range(40)), people(range(100, 130))
    value = lambda ids, k: spark.createDataFrame([(i, f"{k}{rng.randint(4)}") for i in ids if rng.rand() < 0.7 for _ in range(2)], "id long, value string")
    points = {k: (value(range(40), k), value(range(100, 130), k)) for k in ("nickname", "email", "phone", "account")}
    barred = spark.createDataFrame([(int(rng.randint(40)), int(rng.randint(100, 130))) for _ in range(60)], "probe_id long, target_id long")
    copy = lambda df: df.toDF(*df.columns)
    for excluded in (None, barred):
        every = [(r.probe_id, r.score, False, r.target_id) for r in matching.scores(probes, targets, points, excluded).collect()]
        own = [(r.probe_id, r.score, True, r.target_id) for r in matching.scores(probes, copy(probes), {k: (v[0], copy(v[0])) for k, v in points.items()}).collect() if r.target_id < r.probe_id]
        for within, pairs in ((False, every), (True, every + own)):
            want = {}
            for probe, score, among, target in pairs:
                if score >= matching.THRESHOLD:
                    want[probe] = min(want.get(probe, (0, True, 0)), (-score, among, target))
            got = {r.probe_id: (-r.score, r.among, r.target_id) for r in matching.best_matches(probes, targets, points, excluded, within).collect()}
            assert got == want and len(want) > 10


def test_scores_of_classes(spark, monkeypatch):
    """Copies are scored once, as one pair of classes, and all pairs of their members come out, however they are packed."""
    monkeypatch.setattr(matching, "PACK", 7)
    people = lambda n, start: spark.createDataFrame([(start + i, "Mira " if i % 2 else "mira", "Orth", 1) for i in range(n)] + [(start + n, "", None, None), (start + n + 1, None, "", 2)], "id long, firstName string, lastName string, gender int")
    probes, targets = people(60, 0), people(90, 1000)
    value = lambda n, start: spark.createDataFrame([(start + i, v) for i in range(n + 2) for v in ("A@x.org", "a@X.org", "", None)] + [(start + n, "b@x.org")], "id long, value string")
    points = {"email": (value(60, 0), value(90, 1000))}
    p, packs = matching._classes(probes, {"email": points["email"][0]})
    t, _ = matching._classes(targets, {"email": points["email"][1]})
    assert sorted((r["class"], len(r.points)) for r in p.collect()) == [(0, 1), (60, 2), (61, 1)]
    assert sorted(i for r in packs.collect() for i in r.ids) == list(range(62)) and packs.count() > 8
    assert {(r.probe, r.target): r.score for r in matching.class_scores(p, t).collect()} == {(0, 1000): 23, (60, 1090): 3, (60, 1091): 3, (61, 1090): 3, (61, 1091): 3}
    got = sorted(tuple(r) for r in matching.scores(probes, targets, points).collect())
    assert got == sorted([(i, 1000 + j, 23) for i in range(60) for j in range(90)] + [(60 + i, 1090 + j, 3) for i in range(2) for j in range(2)])


def test_merge_precedence(spark):
    rows = [(1, 0, False, "Ines", "Capt.", None), (2, 1, True, "Juno", None, None), (3, 2, False, "Kaya", None, "Jr."), (4, 3, False, "Lior", "", "")]
    df = spark.createDataFrame(rows, "id int, edge int, local boolean, middle string, prefix string, suffix string").withColumn("agg", F.lit(9))
    got = merging.first_values(df, "agg", merging.precedence(F.col("local"), F.col("edge")), ["middle", "prefix", "suffix"]).first()
    assert (got.middle, got.prefix, got.suffix) == ("Juno", "Capt.", "Jr.")


def test_detail_distinct(spark):
    df = spark.createDataFrame([(1, "Acting"), (2, "Bungee"), (3, "Cooking"), (4, "Acting")], "detailId long, hobby string")
    assert [r.hobby for r in details.distinct_details(df, ["hobby"], "detailId", order=[F.col("hobby")]).collect()] == ["Acting", "Bungee", "Cooking"]
    assert [(r.hobby, r.maxId) for r in details.distinct_details(df, ["hobby"], "detailId", most=2).collect()] == [("Acting", 4), ("Cooking", 3)]


def test_changes(spark):
    df = spark.createDataFrame([(i, i % 8, 4 if i == 6 else 0, None) for i in range(8)], "contactId int, changeFlags int, unhandledChangeFlags int, deleted string")
    kinds = {r.contactId: r.k for r in df.select("contactId", changes.classify(F.col("changeFlags")).alias("k")).collect()}
    assert [kinds[i] for i in range(8)] == ["unmodified", "added", "modified", "added", "deleted", "deleted", "deleted", "deleted"]
    cleared = {r.contactId: (r.changeFlags, r.unhandledChangeFlags) for r in changes.clear_flags(df).collect()}
    assert cleared == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (0, 0), 6: (4, 0)}
    gone = changes.soft_delete(df, df.filter("contactId in (1, 5)"), F.lit("now"))
    assert {r.contactId: (r.changeFlags, r.deleted) for r in gone.filter("contactId in (1, 5)").collect()} == {1: (5, "now"), 5: (5, None)}
    back = changes.undelete(gone, F.col("contactId") == 1)
    assert back.filter("contactId = 1").first().changeFlags == 1 and back.filter("contactId = 1").first().deleted is None
    assert changes.is_transient(["Presence", "OnlineAccount"]) and not changes.is_transient(["Presence", "Name"]) and not changes.is_transient(["OnlineAccount"])


def test_delta(spark):
    s = "contactId long, kind string, detailId long, a string, b string"
    old = spark.createDataFrame([(1, "P", 1, "x", "1"), (1, "P", 2, "x", "1"), (1, "P", 3, "y", "2"), (1, "P", 4, "z", None), (2, "P", 5, "q", "q")], s)
    new = spark.createDataFrame([(1, "P", 11, "x", "1"), (1, "P", 3, "y", "3"), (1, "P", 12, "z", ""), (1, "P", 13, "x", "9"), (3, "P", 14, "n", "n")], s)
    got = sorted((r.contactId, r.change, r.oldId, r.newId, r.distance) for r in delta.pairing(old, new, ["contactId", "kind"], ["a", "b"], "detailId").collect())
    assert got == [(1, "modified", 2, 13, 1), (1, "modified", 3, 3, 1), (2, "deleted", 5, None, None), (3, "added", None, 14, None)]
    same = {r.contactId: r.same for r in delta.same_contact(old, old.withColumn("detailId", F.col("detailId") + 9), "contactId", ["a", "b"]).collect()}
    assert same == {1: True, 2: True}


def test_relationships(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "contactId long")
    old = spark.createDataFrame([(1, 2, "K")], "firstId long, secondId long, type string")
    new = spark.createDataFrame([(1, 2, "K"), (1, 1, "K"), (1, 9, "K"), (2, 3, ""), (2, 3, "K"), (2, 3, "K")], old.schema)
    got = {(r.firstId, r.secondId, r.type): (r.verdict, r.repeats) for r in relationships.validity(new, old, people).collect()}
    assert got == {(1, 2, "K"): ("duplicate", 0), (1, 1, "K"): ("self", 0), (1, 9, "K"): ("missing", 0), (2, 3, ""): ("no type", 0), (2, 3, "K"): ("ok", 1)}
    assert relationships.save(old, new, people).count() == 2 and relationships.remove(old, new).count() == 0


class Remote(sync.SyncAdaptor):
    def __init__(self, far):
        super().__init__(match_keys=[("contactId", "contactId")], values=["name"])
        self.far, self.sent = far, None

    def remote_contacts(self, collection):
        return self.far

    def push(self, collection, rows):
        self.sent = {r.contactId: r.change for r in rows.collect()}


def test_sync(spark):
    s = "contactId long, collectionId long, name string, changeFlags int"
    own = spark.createDataFrame([(1, 5, "same", 0), (2, 5, "mine", 2), (3, 5, "old", 0), (4, 5, "gone there", 0), (5, 5, "new here", 1), (6, 5, "dead here", 4), (7, 6, "other", 2)], s)
    far = spark.createDataFrame([(1, "same"), (2, "theirs"), (3, "newer"), (6, "dead here"), (8, "new there")], "contactId long, name string")
    r = Remote(far)
    got = {x.contactId: (x.collectionId, x.name, x.changeFlags) for x in r.sync(own, 5).collect()}
    assert got == {1: (5, "same", 0), 2: (5, "mine", 0), 3: (5, "newer", 0), 5: (5, "new here", 0), 7: (6, "other", 2), 8: (5, "new there", 0)}
    assert r.sent == {2: "modified", 5: "added", 6: "deleted"}


def test_snapshots(spark, tmp_path):
    db = schema.initial(spark)
    assert len(schema.DETAIL_TYPES) == 26 and db["collections"].count() == 2 and db["relationships"].first() == (2, 1, "Aggregates")
    snapshot.write({k: db[k] for k in ("contacts", "Name")}, str(tmp_path))
    back = snapshot.read(spark, str(tmp_path), ["contacts", "Name"])
    assert back["contacts"].schema == schema.CONTACTS and back["contacts"].count() == 2
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    new = spark.createDataFrame([(2, "B", 20), (3, "C", 30)], t.schema)
    assert sorted(map(tuple, snapshot.upsert(t, new, ["id"]).collect())) == [(1, "a", 1), (2, "B", 20), (3, "C", 30)]
    assert sorted(map(tuple, snapshot.masked_update(t, new, "id", ["y"]).collect())) == [(1, "a", 1), (2, "b", 20)]
    left = snapshot.remove(db, spark.createDataFrame([(1,)], "contactId long"))
    assert left["contacts"].count() == 1 and left["relationships"].count() == 0
    assert [(r.pos, r.id, r.exists) for r in snapshot.fetch_by_ids(t, [3, 2, 1], "id").orderBy("pos").collect()] == [(0, 3, False), (1, 2, True), (2, 1, True)]


def test_oob(spark):
    empty = spark.createDataFrame([], schema.OOB)
    put = lambda t, scope, **kv: oob.put(t, scope, spark.createDataFrame([(k, bytearray(v), True) for k, v in kv.items()], "key string, value binary, is_text boolean"))
    t = put(put(put(empty, "a", x=b"1", y=b"abc" * 200), "ab", x=b"2"), "a", x=b"3")
    assert {r.key: bytes(r.value) for r in oob.get(t, "a").collect()} == {"x": b"3", "y": b"abc" * 200}
    assert sorted(r.key for r in oob.keys(t, "a").collect()) == ["x", "y"]
    t = oob.remove(t, "a")
    assert oob.keys(t, "a").count() == 0 and oob.keys(t, "ab").count() == 1


def test_streams(spark, tmp_path, sf_dir):
    from kithbase.streaming import feeds

    source = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS contactId", "CAST(ts AS TIMESTAMP) AS at", "CAST(event_id % 7 AS INT) AS state", "event_type AS kind")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = feeds.presence_overlay(stream, "contactId", "at", "state").writeStream.outputMode("complete").format("memory").queryName("overlay").start()
    q.processAllAvailable()
    q.stop()
    want = {r[0]: r[1] for r in source.groupBy("contactId").agg(F.max_by("state", "at")).collect()}
    assert {r.contactId: r.presenceState for r in spark.table("overlay").collect()} == want
    q = feeds.change_feed(stream, "at", "kind").writeStream.outputMode("complete").format("memory").queryName("feed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("feed").agg(F.sum("n")).first()[0] == source.count()
