"""Entity resolution: which aggregate a new record belongs to.

scores() lists scored pairs: nine branches as equi-joins, added up by pair,
with blocking on names; pairs of classes of people who are alike, to which
their members come last. best_matches() finds the best target of each probe by
the keys that both share, without listing pairs. attach() turns matches into
edges, and into new aggregates where there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from ..plans.sorting import numbered
from ..sources.shared import discard, stash

# Scores of the branches and the threshold.
FULL_NAME, NICKNAME_ONLY, FIRST_NAME, LAST_NAME, CONTACT_POINT, SAME_NICKNAME = 20, 15, 12, 12, 3, 1
THRESHOLD = 15
#: Fixed value: members of a class that stand in one row.
PACK = 1024


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.trim(F.col(c)), F.lit("")))


def _classes(people: DataFrame, points: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Those that share all that scores depend on are one class, named by its least id: class, first, last, gender, points (kind and value) of the classes; class, pack, ids of their members, packs being of at most some PACK ids."""
    own = people.filter("id IS NOT NULL").select("id", _low("firstName").alias("first"), _low("lastName").alias("last"), F.coalesce(F.col("gender"), F.lit(0)).alias("gender"))
    kind = "array<struct<kind:string,value:string>>"
    values = [t.filter(~blank(F.col("value"))).select("id", F.struct(F.lit(k).alias("kind"), F.lower("value").alias("value")).alias("x")) for k, t in points.items()]
    if values:
        own = own.join(reduce(DataFrame.union, values).groupBy("id").agg(F.sort_array(F.collect_set("x")).cast(kind).alias("points")), "id", "left")
    own = stash(own.withColumn("points", F.coalesce("points", F.array().cast(kind)) if values else F.array().cast(kind)), "people")
    same = ["first", "last", "gender", "points"]
    classes = stash(own.groupBy(*same).agg(F.min("id").alias("class"), F.count("*").alias("n")), "classes")
    placed = own.join(classes, same).select("class", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PACK)).alias("pack"), "id")
    packs = stash(placed.groupBy("class", "pack").agg(F.collect_list("id").alias("ids")), "packs")
    discard(own)
    return classes.drop("n"), packs


def class_scores(probes: DataFrame, targets: DataFrame) -> DataFrame:
    """probe, target, score of all pairs of classes (class, first, last, gender, points) that share something."""
    names = lambda people, side: people.select(F.col("class").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("first", "last", "gender")])
    p, t = names(probes, "probe"), names(targets, "target")
    value = lambda people, side: people.select(F.col("class").alias(side), F.explode("points").alias("x")).select(side, "x.*")
    nameless = lambda side: (F.col(f"{side}_first") == "") & (F.col(f"{side}_last") == "")
    pair = lambda df, score: df.select("probe", "target", F.lit(score).alias("score"))
    same = lambda part: (F.col(f"probe_{part}") == F.col(f"target_{part}")) & (F.col(f"probe_{part}") != "")
    branches = [pair(p.join(t, same("first") & same("last")), FULL_NAME)]
    for part, other, score in (("first", "last", FIRST_NAME), ("last", "first", LAST_NAME)):
        # Only those without the other part meet everybody of that name.
        branches.append(pair(p.filter(F.col(f"probe_{other}") == "").join(t, same(part)), score))
        branches.append(pair(p.filter(F.col(f"probe_{other}") != "").join(t.filter(F.col(f"target_{other}") == ""), same(part)), score))
    shared = value(probes, "probe").join(value(targets, "target"), ["kind", "value"])
    nick = shared.filter("kind = 'nickname'")
    branches.append(pair(nick.join(p.filter(nameless("probe")).select("probe"), "probe", "left_semi").join(t.filter(nameless("target")).select("target"), "target", "left_semi"), NICKNAME_ONLY))
    branches.append(shared.select("probe", "target", F.when(F.col("kind") == "nickname", SAME_NICKNAME).otherwise(CONTACT_POINT).alias("score")))
    total = reduce(DataFrame.union, branches).distinct().groupBy("probe", "target").agg(F.sum("score").cast("long").alias("score"))
    # Blocking: last names agree or one is blank, nobody with a name meets somebody with a nickname alone, genders aren't opposite.
    allowed = total.join(p, "probe").join(t, "target")
    allowed = allowed.filter(((F.col("probe_last") == F.col("target_last")) | (F.col("probe_last") == "") | (F.col("target_last") == "")) & (nameless("probe") == nameless("target")))
    return allowed.filter(F.col("probe_gender") + F.col("target_gender") != 3).select("probe", "target", "score")


def scores(probes: DataFrame, targets: DataFrame, points: dict[str, tuple[DataFrame, DataFrame]], excluded: DataFrame | None = None) -> DataFrame:
    """probe_id, target_id, score of all pairs that share something.

    probes, targets: id (unique on its side), firstName, lastName, gender (0
    none, 1 and 2 opposite). points: nickname, email, phone (minimised),
    account -> two tables of id, value. excluded: probe_id, target_id that
    must not match. Equal scores of one pair count once: sharing an email and
    a phone is worth no more than either.

    Scored are pairs of classes, of people who agree in all that counts;
    their members are put in at the end, packs against packs, and those pairs
    are only written out. So joins and sums don't grow with the numbers of
    copies, but the result does: a value that n probes and m targets share
    makes n * m rows. best_matches() finds the best target of each probe
    without them.
    """
    p, of_p = _classes(probes, {k: v[0] for k, v in points.items()})
    t, of_t = _classes(targets, {k: v[1] for k, v in points.items()})
    packs = lambda df, side: df.select(F.col("class").alias(side), F.col("pack").alias(f"{side}_pack"), F.col("ids").alias(f"{side}_ids"))
    units = class_scores(p, t).join(packs(of_p, "probe"), "probe").join(packs(of_t, "target"), "target")
    # By number, as a plan by size would put a few MB of packs, and all the pairs they stand for, into one task.
    spark = probes.sparkSession
    dealt = units.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "probe", "probe_pack", "target", "target_pack")
    out = dealt.select(F.explode("probe_ids").alias("probe_id"), "target_ids", "score").select("probe_id", F.explode("target_ids").alias("target_id"), "score")
    return out if excluded is None else out.join(excluded.select("probe_id", "target_id"), ["probe_id", "target_id"], "left_anti")


def best(pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """For each probe the target of the highest score that reaches the threshold; the lowest id of equal ones. Partial aggregation, no window."""
    top = pairs.filter(F.col("score") >= threshold).groupBy("probe_id").agg(F.max(F.struct("score", (-F.col("target_id")).alias("target"))).alias("m"))
    return top.select("probe_id", (-F.col("m.target")).alias("target_id"), F.col("m.score").alias("score"))


# --- the best target of each probe, without listing pairs --------------------------------------------------------

def _people(people: DataFrame, points: dict[str, DataFrame], place: Column) -> DataFrame:
    """id, place, first, last, gender, nicks and points (kind:value) of each person; places are compared to tell who comes first."""
    out = people.select("id", place.alias("place"), _low("firstName").alias("first"), _low("lastName").alias("last"), F.coalesce("gender", F.lit(0)).alias("gender"))
    values = {"nicks": [points["nickname"].select("id", F.lower("value").alias("v"))] if "nickname" in points else [], "points": [t.select("id", F.concat(F.lit(f"{k}:"), F.lower("value")).alias("v")) for k, t in points.items() if k != "nickname"]}
    values["nicks"] = [t.filter(~blank(F.col("v"))) for t in values["nicks"]]
    values["points"] = [t.filter(~F.col("v").rlike("^[a-z]+:$") & F.col("v").isNotNull()) for t in values["points"]]
    for name, tables in values.items():
        sets = reduce(DataFrame.union, tables).groupBy("id").agg(F.collect_set("v").alias(name)) if tables else None
        out = out.join(sets, "id", "left") if sets is not None else out.withColumn(name, F.lit(None).cast("array<string>"))
    return out


def _entries(people: DataFrame, probing: bool) -> DataFrame:
    """A row for each way in which a person can reach the threshold: way, key (what both must share), score, and the person.

    Ways are a full name; one name, where the other is blank on one side, and
    a shared point; a nickname where there is no name. A shared nickname or
    point adds to the score, as further parts of the key.
    """
    first, last = F.col("first"), F.col("last")
    nameless = (first == "") & (last == "")
    probe_blank, target_blank = (lambda c: c == "", lambda c: F.lit(True)) if probing else (lambda c: F.lit(True), lambda c: c == "")
    # One of the two sides has the other part blank: the probe (p), or the target while the probe has it (t).
    side_p = lambda part, other: (part != "") & probe_blank(other)
    side_t = lambda part, other: (part != "") & ((other != "") if probing else target_blank(other))
    none, nicks, points = F.array(F.lit("")), F.coalesce("nicks", F.array().cast("array<string>")), F.coalesce("points", F.array().cast("array<string>"))
    ways = [("full", (first != "") & (last != ""), [first, last], FULL_NAME)]
    for name, part, other, score in (("first", first, last, FIRST_NAME), ("last", last, first, LAST_NAME)):
        ways += [(f"{name}-p", side_p(part, other), [part], score), (f"{name}-t", side_t(part, other), [part], score)]
    out = []
    for way, holds, key, score in ways:
        for nick, point in ((0, 0), (0, 1), (1, 0), (1, 1)):
            if score + SAME_NICKNAME * nick + CONTACT_POINT * point >= THRESHOLD:
                out.append((f"{way}{nick}{point}", holds, key, nicks if nick else none, points if point else none, score + SAME_NICKNAME * nick + CONTACT_POINT * point))
    out += [(f"nick{point}", nameless, [], nicks, points if point else none, NICKNAME_ONLY + SAME_NICKNAME + CONTACT_POINT * point) for point in (0, 1)]
    rows = F.filter(F.array(*[F.when(holds, F.struct(F.lit(way).alias("way"), F.lit(score).alias("score"), F.array(*key).cast("array<string>").alias("key"), n.alias("n"), p.alias("p"))) for way, holds, key, n, p, score in out]), lambda x: x.isNotNull())
    spread = people.select("id", "place", "gender", F.explode(rows).alias("e")).select("id", "place", "gender", "e.*")
    spread = spread.select("id", "place", "gender", "way", "score", "key", F.explode("n").alias("nick"), "p").select("id", "place", "gender", "way", "score", "key", "nick", F.explode("p").alias("point"))
    return spread.select("id", "place", "gender", "score", F.concat(F.array("way"), F.col("key"), F.array("nick", "point")).alias("key"))


def best_matches(probes: DataFrame, targets: DataFrame, points: dict[str, tuple[DataFrame, DataFrame]], excluded: DataFrame | None = None, within: bool = False) -> DataFrame:
    """probe_id, target_id, score, among: the target of the highest score from THRESHOLD on, of equal ones the lowest id.

    within: probes with lower ids are targets as well (among is true for
    those), after all targets of the same score; so equal probes find each
    other. Other arguments are those of scores().

    Which of the sharers of a key a probe would take doesn't depend on the
    probe but for its gender and its own place, so the first by gender is found
    for each key by partial aggregation, and each probe meets at most three
    rows a key: no key makes pairs, however many share it. Only probes with
    exclusions are compared with all that share a key with them.
    """
    there = lambda p, among: F.struct(F.lit(among).alias("among"), F.col("id").alias("id"))
    asked = _people(probes, {k: v[0] for k, v in points.items()}, there(probes, True))
    known = _people(targets, {k: v[1] for k, v in points.items()}, there(targets, False))
    if within:
        known = known.unionByName(asked)
    first = _entries(known, False).groupBy("key", "gender").agg(F.min("place").alias("target"))
    genders = F.when(F.col("gender") == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.col("gender")))
    wanted = _entries(asked, True).select("id", "place", "score", "key", F.explode(genders).alias("gender"))
    found = wanted.join(first, ["key", "gender"]).filter(F.col("target") < F.col("place")).select(F.col("id").alias("probe_id"), "score", "target")
    if excluded is not None:
        barred = excluded.select("probe_id", "target_id").distinct()
        own = probes.join(barred.select(F.col("probe_id").alias("id")).distinct(), "id", "left_semi")
        plain = scores(own, targets, points, barred).withColumn("among", F.lit(False))
        if within:
            # the same tables on both sides, as copies with columns of their own
            copy = lambda df: df.toDF(*df.columns)
            plain = plain.unionByName(scores(own, copy(probes), {k: (v[0], copy(v[0])) for k, v in points.items()}).filter("target_id < probe_id").withColumn("among", F.lit(True)))
        plain = plain.filter(F.col("score") >= THRESHOLD).select("probe_id", F.col("score").cast("int").alias("score"), F.struct("among", F.col("target_id").alias("id")).alias("target"))
        found = found.join(own.select(F.col("id").alias("probe_id")), "probe_id", "left_anti").unionByName(plain)
    top = found.groupBy("probe_id").agg(F.min(F.struct((-F.col("score")).alias("score"), "target")).alias("m"))
    return top.select("probe_id", F.col("m.target.id").alias("target_id"), (-F.col("m.score")).cast("long").alias("score"), F.col("m.target.among").alias("among"))


def _settled(own: DataFrame) -> DataFrame:
    """probe_id, target_id, among with chains of probes followed to their ends; a probe that founds has itself. Each round doubles the reach."""
    state = stash(own.select("probe_id", F.coalesce("target_id", "probe_id").alias("target_id"), F.coalesce("among", F.lit(True)).alias("among")), "matches")
    while True:
        far = state.select(F.col("probe_id").alias("p"), F.col("target_id").alias("t"), F.col("among").alias("a"))
        step = state.join(far, F.col("among") & (F.col("target_id") == F.col("p")), "left")
        new = stash(step.select("probe_id", F.when(F.col("among"), F.col("t")).otherwise(F.col("target_id")).alias("target_id"), F.when(F.col("among"), F.col("a")).otherwise(F.lit(False)).alias("among"), (F.col("among") & (F.col("t") != F.col("target_id")) | F.col("among") & ~F.col("a")).alias("moved")), "matches")
        discard(state)
        state = new.select("probe_id", "target_id", "among")
        if new.filter("moved").isEmpty():
            return state


def attach(probes: DataFrame, matches: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """Edges (aggregate, record) of all probes, and the aggregates that are new.

    A probe that matched a target joins it; one that matched another probe
    joins what that one joins; one without a match founds an aggregate. New
    ones get consecutive ids from next_id on, in the order of their founders.
    """
    named = matches if "among" in matches.columns else matches.withColumn("among", F.lit(False))
    own = probes.select(F.col("id").alias("probe_id")).join(named.select("probe_id", "target_id", "among"), "probe_id", "left")
    placed = _settled(own)
    founders = placed.filter(F.col("among") & (F.col("probe_id") == F.col("target_id"))).select(F.col("probe_id").alias("source"))
    new = stash(numbered(founders.orderBy("source"), "contactId", next_id).select(F.col("contactId").cast("long").alias("contactId"), "source"), "founders")
    edges = placed.filter(~F.col("among")).select(F.col("target_id").alias("firstId"), F.col("probe_id").alias("secondId"))
    edges = edges.union(placed.filter("among").join(new.withColumnRenamed("source", "target_id"), "target_id").select("contactId", "probe_id"))
    return edges.withColumn("type", F.lit("Aggregates")), new
