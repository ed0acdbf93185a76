"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions alone.

A paragraph is a line, and a leaf: its digest is the SHA-256 of its text. A
section is a run of eight paragraphs; its digest is the SHA-256 of theirs. The
root is the SHA-256 of the sections' digests. Digests of leaves and sections
are kept to 128 bits, the root to all 256. So equal roots mean equal texts,
and where two roots differ, equal sections and paragraphs can be passed over:
the branches that differ say where the edit is.

With each leaf stand the hashes of its pieces, runs of up to four words (40
characters at most count as one word). They are no part of the tree; how alike
two fingerprints are is read from the pieces of the branches that differ.

A fingerprint is root|section|section..., a section digest=leaf;leaf..., a
leaf digest:pieces, all digests in hexadecimal digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType, StringType

from .store import stash

PIECE = r"(?:[^\x20\x09-\x0D]{1,40}+[\x20\x09-\x0D]*+){1,4}+|[\x20\x09-\x0D]++"
SECTION = 8
#: Hexadecimal digits of the digests of leaves and sections, of the root, and of pieces.
DIGEST, ROOT, PIECE_DIGITS = 32, 64, 8
#: Rows between two cuts of the order of ids; cuts of a range at a level; levels.
ROWS_PER_RANGE, FANOUT, LEVELS = 2_000, 256, 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _hex(digest: Column) -> Column:
    return F.lpad(F.lower(F.hex(digest.cast("long").bitwiseAND(0xFFFFFFFF))), PIECE_DIGITS, "0")


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGEST)


def leaves(text: Column) -> Column:
    """array<string>: for each paragraph its digest and the hashes of its pieces."""
    pieces = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PIECE), 0), lambda x: _hex(F.hash(x))), "")
    return F.transform(F.split(text, "\n"), lambda p: F.concat(_digest(p), F.lit(":"), pieces(p)))


def sections(leaves_: Column) -> Column:
    """array<string>: for each run of eight leaves its digest, made from theirs, and the leaves."""
    runs = F.transform(F.sequence(F.lit(1), F.size(leaves_), F.lit(SECTION)), lambda i: F.slice(leaves_, i, SECTION))
    digest = lambda run: _digest(F.array_join(F.transform(run, lambda x: F.substring(x, 1, DIGEST)), ""))
    return F.transform(runs, lambda run: F.concat(digest(run), F.lit("="), F.array_join(run, ";")))


def rendered(sections_: Column) -> Column:
    """The fingerprint: the root, made from the sections' digests, and the sections."""
    root = F.sha2(F.array_join(F.transform(sections_, lambda s: F.substring(s, 1, DIGEST)), ""), 256)
    return F.concat(root, F.lit("|"), F.array_join(sections_, "|"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string; null counts as empty."""
    return _let(sections(leaves(F.coalesce(text, F.lit("")))), rendered)


def root(fp: Column) -> Column:
    return F.substring(fp, 1, ROOT)


def branches(fp: Column) -> Column:
    """The sections of a fingerprint."""
    return F.split(F.substr(fp, F.lit(ROOT + 2)), r"\|")


def leaves_of(sections_: Column) -> Column:
    """The leaves of some sections."""
    return F.flatten(F.transform(sections_, lambda s: F.split(F.substr(s, F.lit(DIGEST + 2)), ";")))


def pieces_of(leaves_: Column) -> Column:
    """The hashes of the pieces of some leaves, each once."""
    return F.array_distinct(F.flatten(F.transform(leaves_, lambda x: F.regexp_extract_all(F.substr(x, F.lit(DIGEST + 2)), F.lit(f".{{{PIECE_DIGITS}}}"), 0))))


def likeness(same: Column, sections_a: Column, leaves_b: Column, pieces_a: Column, pieces_b: Column) -> Column:
    """1 for equal roots; else the share of pieces in common, 2|A&B| / (|A|+|B|), each piece once; 0 without pieces.

    What A has and B lacks can only stand in paragraphs of A that B lacks, and
    these only in sections that B lacks: sections_a are those. All set
    operations are on strings, which Spark does by hashing.
    """
    total = F.size(pieces_a) + F.size(pieces_b)
    lacking = F.size(F.array_except(pieces_of(F.array_except(leaves_of(sections_a), leaves_b)), pieces_b))
    return F.when(same, 1.0).when(total == 0, 0.0).otherwise(2.0 * (F.size(pieces_a) - lacking) / total).cast("double")


def alike(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints, from nothing but them."""
    parts = lambda fp: _let(leaves_of(branches(fp)), lambda x: F.struct(x.alias("leaves"), pieces_of(x).alias("pieces")))
    both = F.struct(parts(a).alias("a"), parts(b).alias("b"), F.array_except(branches(a), branches(b)).alias("apart"))
    return _let(both, lambda x: likeness(root(a) == root(b), x["apart"], x["b"]["leaves"], x["a"]["pieces"], x["b"]["pieces"]))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of fingerprint a that stand nowhere in b: sections that b has aren't looked into."""
    other = F.struct(branches(b).alias("sections"), leaves_of(branches(b)).alias("leaves"))
    none = F.array().cast("array<int>")

    def within(o: Column) -> Column:
        lost = lambda s, i: F.filter(F.transform(F.split(F.substr(s, F.lit(DIGEST + 2)), ";"), lambda p, j: F.when(~F.array_contains(o["leaves"], p), i * SECTION + j)), lambda n: n.isNotNull())
        return F.flatten(F.transform(branches(a), lambda s, i: F.when(F.array_contains(o["sections"], s), none).otherwise(lost(s, i))))

    return _let(other, within)


# --- the next document -------------------------------------------------------------------------------------------


def _key(docs: DataFrame) -> Column:
    """A number that never falls where doc_id rises: the id itself, or the first seven bytes of a text; null first."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    if isinstance(kind, StringType):
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode("doc_id", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1).cast("long"))
    return F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))


def _ranged(rows: DataFrame, key: DataFrame) -> DataFrame:
    """rows with a range number that rises with `key`: cuts of the order, level by level.

    key: the keys alone, of which each level makes one pass. A level cuts each
    range of the level before into up to FANOUT by quantiles, found by
    distributed sketches. A level's table of cuts has a row for each range
    before it, 65536 at most, which bounds what is broadcast.
    """
    wanted = max(1, key.count() // ROWS_PER_RANGE)
    quantiles = lambda parts: F.array_distinct(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts))
    below = lambda cuts: F.size(F.filter(cuts, lambda x: x <= F.col("key"))).cast("long")
    parts = min(FANOUT, wanted)
    # The first cuts, FANOUT at most, stand in the plan.
    first = key.agg(quantiles(parts)).first()[0] if parts > 1 else None
    out, path = (df.withColumn("range", below(F.array(*map(F.lit, first))) if first else F.lit(0).cast("long")) for df in (rows, key))
    for _ in range(1, LEVELS):
        wanted = -(-wanted // parts)
        if wanted <= 1:
            break
        parts = min(FANOUT, wanted)
        cuts = F.broadcast(stash(path.groupBy(F.col("range").alias("before")).agg(quantiles(parts).alias("cuts")), "cuts"))
        out, path = (df.join(cuts, F.col("range") == F.col("before")).withColumn("range", F.col("range") * FANOUT + below("cuts")).drop("before", "cuts") for df in (out, path))
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending doc_id (then hash of text); after the last comes the first.

    Texts move once, dealt by range of ids; no range is the whole table. The
    first row of each range is also given to the range before it, so that a
    look ahead never leaves its range. Ids may be numbers or texts. Rows of one
    doc_id stay in one range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _key(docs).alias("key")).withColumn("h", F.xxhash64("text"))
    rows = _ranged(rows, docs.select(_key(docs).alias("key"))).drop("key")
    first = stash(rows.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("range", F.col("f.doc_id").alias("id"), F.col("f.h").alias("gh")), "first")
    # The range before each: within a run of ranges, or the last one of the run before; before the first stands the last of all.
    run = F.floor(F.col("range") / FANOUT)
    runs = first.groupBy(run.alias("run")).agg(F.max("range").alias("last"))
    ends = runs.select("run", F.coalesce(F.lag("last").over(W.orderBy("run")), F.max("last").over(W.partitionBy())).alias("before"))
    ghosts = stash(first.withColumn("run", run).join(ends, "run").select(F.coalesce(F.lag("range").over(W.partitionBy("run").orderBy("range")), F.col("before")).alias("to"), "id", "gh"), "ghosts")
    # A written table's size is known: Spark broadcasts a small one and joins a large one by its keys.
    lent = rows.join(ghosts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("gh"))).dropDuplicates(["to", "id", "gh"])
    both = rows.select("doc_id", "text", "h", "range", F.lit(0).alias("ghost")).union(lent.select("doc_id", "text", "h", F.col("to").alias("range"), F.lit(1)))
    ahead = F.lead("text").over(W.partitionBy("range").orderBy("ghost", "doc_id", "h"))
    return both.withColumn("next_text", ahead).filter("ghost = 0").select("doc_id", "text", "next_text")


def edited(n: Column, text: Column, following: Column) -> Column:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - k).cast("int")), F.substring(following, F.lit(1), k))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs (doc_id, text) and of its edited text, with their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null texts count as empty; empty texts have a
    fingerprint of one empty paragraph. Repeated rows follow one another in
    the order of ids. Null ids come first. Very long texts are one row like
    others. Extra columns are left out. An empty table gives an empty result.
    """
    texts = ("text", "edited", "next_text")
    n = F.char_length("text").cast("long")
    step = with_next(docs).select("doc_id", "text", "next_text", n.alias("n_chars"))
    step = step.withColumn("edited", edited(F.col("n_chars"), F.col("text"), F.col("next_text")))
    step = step.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[leaves(F.col(c)).alias(f"l_{c}") for c in texts])
    step = step.select("*", *[sections(F.col(f"l_{c}")).alias(f"s_{c}") for c in texts], *[pieces_of(F.col(f"l_{c}")).alias(f"p_{c}") for c in texts])
    step = step.select("*", *[rendered(F.col(f"s_{c}")).alias(f"f_{c}") for c in texts])
    near = lambda c: likeness(root(F.col("f_text")) == root(F.col(f"f_{c}")), F.array_except("s_text", f"s_{c}"), F.col(f"l_{c}"), F.col("p_text"), F.col(f"p_{c}"))
    return step.select("doc_id", "n_chars", "edited_sha256", F.col("f_text").alias("fingerprint"), F.col("f_edited").alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next_text").alias("near_next"))
