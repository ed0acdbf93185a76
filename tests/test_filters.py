"""Filters, ranges, relationships and sorts over a small set of records."""

import pytest

from kithbase.plans.binding import Binding, Details, Field
from kithbase.plans.compile import select
from kithbase.plans.filters import And, Detail, Everything, Ids, Nothing, Or, Range, Related, UnsupportedFilter
from kithbase.plans.sorting import Sort, ordered, ranked

LETTERS = "abcdefghijk"
NAMES = [("Anders", "Keston"), ("Bibi", "Kesten"), ("Bruno", "Kestun"), ("Dorte", "Lindqvist"), ("Jonas", "Marlee"), ("Jonas", "Marley"), ("Jonas", "Marly"), ("xeno", None), ("Xeno", None), ("xEno", None), ("Yngve", None)]
PHONES = [(1, "5551212"), (2, "+55553456")]
TEXTS = {5: "", 7: "zzz"}


@pytest.fixture(scope="module")
def b(spark):
    people = spark.createDataFrame([(i + 10, 2, 0, False) for i in range(len(LETTERS))], "contactId long, collectionId long, changeFlags int, isDeactivated boolean")
    names = spark.createDataFrame([(i + 10, f, l) for i, (f, l) in enumerate(NAMES)], "contactId long, firstName string, lastName string")
    phones = spark.createDataFrame([(i + 9, p) for i, p in PHONES], "contactId long, phoneNumber string")
    nicks = spark.createDataFrame([(10, "Old Anders"), (11, "Old Bibi")], "contactId long, nickname string")
    texts = spark.createDataFrame([(i + 9, t) for i, t in TEXTS.items()], "contactId long, text string")
    edges = spark.createDataFrame([(10, 11, "HasSpouse"), (10, 11, "Odd")], "firstId long, secondId long, type string")
    d = lambda t, f, k="string", s=False: Details(t, "contactId", {x: Field(x, k) for x in f}, singular=s)
    return Binding(people, details={"Name": d(names, ["firstName", "lastName"], s=True), "PhoneNumber": d(phones, ["phoneNumber"], "phone"), "Nickname": d(nicks, ["nickname"]), "Text": d(texts, ["text"], s=True)}, edges=edges)


def letters(df):
    return "".join(sorted(LETTERS[r.contactId - 10] for r in df.collect()))


first = lambda v, m="exact", **k: Detail("Name", "firstName", v, m, fixed_string=True, **k)
last = lambda v, m="exact", **k: Detail("Name", "lastName", v, m, fixed_string=True, **k)
number = lambda v, m="exact": Detail("PhoneNumber", "phoneNumber", v, m, phone=True)


@pytest.mark.parametrize("tree, want", [
    (first(""), ""), (last(""), "hijk"), (first("A", "starts"), "a"), (first("anders", "starts"), "a"), (last("K", "starts"), "abc"), (first("nde", "contains"), "a"), (first("ers", "ends"), "a"), (last("n", "ends"), "abc"),
    (Detail("Nickname"), "ab"), (Detail("Nickname", "nickname", "Anders", "contains"), "a"), (Detail("PhoneNumber"), "ab"), (Detail("PhoneNumber", "phoneNumber", "555", "contains"), "ab"), (Detail("PhoneNumber", "phoneNumber", "555", "starts"), "a"),
    (number("555-1212"), "a"), (number("(555)1212"), "a"), (number("5 5 5 1 2 1 2"), "a"), (number("+55553456"), "b"), (number("(5555)3456"), "b"), (number("555", "starts"), "ab"), (number("+555", "starts"), "ab"), (number("(555)", "starts"), "ab"),
    (Range("Name", "firstName", "a", ignore_case=True), "abcdefghijk"), (Range("Name", "firstName", "bibi", ignore_case=True), "bcdefghijk"), (Range("Name", "firstName", "ZamBeZI", ignore_case=True), ""), (Range("Name", "firstName", most="bIbi", ignore_case=True), "a"),
    (Range("Name", "firstName", "Xambezi"), "hijk"), (Range("Name", "firstName", most="Xambezi"), "abcdefg"), (Range("PhoneNumber", "phoneNumber", "5551200", "5551220"), "a"),
    (Ids((11, 10, 10)), "ab"), (Everything(), LETTERS), (Nothing(), ""), (And((Detail("Nickname"), Nothing())), ""), (And((Or(()), Detail("Nickname"))), "ab"),
    (Related("HasSpouse", None, "second"), "a"), (Related("HasSpouse", None, "first"), "b"), (Related("HasSpouse", None, "either"), "ab"), (Related("Odd", 10, "first"), "b"), (Related(None, 11, "second"), "a"),
    (Or((first("Bibi"), Detail("PhoneNumber", "phoneNumber", "5551212"), Range("Name", "firstName", "Y"))), "abhjk"),
    # each detail filter may match another detail of the record
    (And((Detail("Nickname", "nickname", "Bibi", "contains"), Detail("Name", "firstName", "Bibi"))), "b"),
])
def test_filter(b, tree, want):
    assert letters(select(tree, b)) == "".join(sorted(want))


@pytest.mark.parametrize("tree", [Detail(""), Detail("Nothing"), Detail("Name", "nothing", "x"), Ids(()), number("abc"), Detail("Name", "firstName", "a", keypad=True), Related("x", 1, "third")])
def test_unsupported(b, tree):
    with pytest.raises(UnsupportedFilter):
        select(tree, b)


def test_case(b):
    assert letters(select(Detail("Name", "firstName", "XENO"), b)) == ""
    assert letters(select(first("XENO"), b)) == "hij"
    assert letters(select(first("Xeno", case_sensitive=True), b)) == "i"


def test_wildcards_are_literal_unless_wanted(b):
    assert letters(select(Detail("Name", "firstName", "B?bi"), b)) == ""
    assert letters(select(Detail("Name", "firstName", "B[ir]*", wildcards=True), b)) == "bc"


@pytest.mark.parametrize("keys, want", [
    ([Sort("Name", "firstName")], "abcdefgijkh"[:7]), ([Sort("Name", "lastName")], "bacdefghijk"), ([Sort("Name", "lastName", descending=True)], "gfedcabhijk"), ([Sort("Name", "lastName", blanks="first")], "hijkbacdefg"),
    ([Sort("Name", "firstName", descending=True), Sort("Name", "lastName")], None), ([Sort("Text", "text")], "gabcdefhijk"), ([Sort("PhoneNumber", descending=True)], "abcdefghijk"), ([Sort("PhoneNumber", "phoneNumber")], LETTERS),
])
@pytest.mark.filterwarnings("ignore:sort by")
def test_sort(b, keys, want):
    got = "".join(LETTERS[r.contactId - 10] for r in ordered(b, b.records, keys).collect())
    ranks = sorted((r["rank"], LETTERS[r.contactId - 10]) for r in ranked(b, b.records, keys).collect())
    assert [r for r, _ in ranks] == list(range(1, 12)) and "".join(c for _, c in ranks) == got
    assert want is None or got.startswith(want)


def test_limit(b):
    assert [r.contactId for r in ordered(b, b.records, [Sort("Name", "lastName")], 3).collect()] == [11, 10, 12]
