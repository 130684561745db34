"""Line deduplication by a segment-partition edit join, in SQL functions only.

Lines within two edits of each other are of one class (through others, too), and of each class
only the first occurrence stays: by doc_id, a hash of the text, and place in the document. Lines
under 24 characters are never touched: two edits say little about them, and prose repeats them.

A line is cut into three segments; two edits leave at least one of them as it was. Each line is
indexed under (its length, segment number, segment), and looks up, for its own length and up to
two less, the substrings that can be such a segment: only starts that leave few enough edits on
either side. Lines that meet, and whose counts of common characters allow for it, are compared by
an edit distance kept to the band of diagonals within two of the main one. Where very many lines
stand under one signature, they are compared as they meet, so that only links come out.

Lines pass as numbers and 64-bit hashes until two have met, or stand under a signature of very many;
only the texts of those move, and in the end the documents that lose lines. NULL texts have no lines; the text of a document that loses nothing
stays as it is. Repeated rows (equal id and text) are one document, so they
keep the same lines. Empty tables give no rows. `clean` keeps extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulith.llm.common import connected, free, marked, materialize, narrowed, table
from tabulith.session import methods_split, small_side

EDITS, SHORTEST = 2, 24
#: Characters whose counts in the ends of lines, packed into 24 bits, are compared before texts are.
COMMON, ENDS, BAG = "etaoinsr", 72, 24
#: A signature that this many of one line in `ONE_IN` are indexed under is a crowded one. It decides on
#: where lines are compared, not on whether.
MANY, ONE_IN = 8, 4


def signed(lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """To lines (line, …): `own`, an array of what a line is indexed under, and `more`, of what else
    it is looked up under; NULL where a segment would not fit. An entry is 40 bits of a hash before
    the 24 of the line's spectrum.

    A line of n characters has edits + 1 segments of n // (edits + 1) characters, the last ones
    one longer. Looked up is, for a line `less` characters shorter and its segment i, each start
    that leaves at most i edits before the segment and at most edits - i after it.
    """
    parts = edits + 1
    rest = [c for c in lines.columns if c != "line"]
    # Step by step: what several expressions read is worked out once.
    n, line, ends = F.char_length("line"), F.col("line"), F.lit(ENDS)
    plain = F.octet_length("line") == n  # a byte per character: no walk through the text to find one
    step = lines.select(*rest, "line", n.alias("n"), plain.alias("plain"), line.cast("binary").alias("raw"), F.when(n <= 2 * ends, line).otherwise(
        F.concat(F.left(line, ends), F.right(line, ends))).alias("ends"))
    step = step.select(*rest, "line", "n", "plain", "raw", spectrum(F.col("ends")).cast("long").alias("bag"), *[
        f(F.col("n") - less).alias(f"{name}{less}") for less in range(parts)
        for name, f in (("base", lambda of: F.floor(of / parts).cast("int")), ("over", lambda of: of % parts))])
    segments = [(less, i) for less in range(parts) for i in range(parts)]
    step = step.select(*rest, "line", "n", "plain", "raw", "bag", *[
        c for less, i in segments for base, over in [(F.col(f"base{less}"), F.col(f"over{less}"))] for c in (
            (base + (over >= parts - i).cast("int")).alias(f"size{less}_{i}"),
            (1 + base * i + F.greatest(F.lit(0), i + over - parts)).alias(f"at{less}_{i}"))])

    def entry(less: int, i: int, shift: int) -> Column:
        of, size, at = F.col("n") - less, F.col(f"size{less}_{i}"), F.col(f"at{less}_{i}") + shift
        fits = (at >= 1) & (at + size - 1 <= F.col("n")) & (of >= shortest)
        part = F.when(F.col("plain"), F.substring(F.col("raw"), at, size)).otherwise(
            F.substring(line, at, size).cast("binary"))
        sig = F.xxhash64(of, F.lit(i), part)
        return F.when(fits, F.shiftleft(sig, BAG).bitwiseOR(F.col("bag")))

    tries = [(less, i, shift) for less, i in segments
             for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    own = [t for t in tries if t[0] == t[2] == 0]
    return step.select(*rest, F.array(*[entry(*t) for t in own]).alias("own"),
                       F.array(*[entry(*t) for t in tries if t not in own]).alias("more"))


def spectrum(ends: Column) -> Column:
    """How often each of 8 common characters occurs in the ends of a line, modulo 8, three bits each:
    in its first and last `ENDS` characters, or the whole line if there are no more.

    In a line of no more than both ends, or further in than one of them, an edit changes one of the
    counts by one, or two of them: what it pushes out of an end or draws in is one character. Nor do
    more of them change where one of two lines is a little longer than both ends: the characters
    left out in its middle are no more than those put in.
    """
    size, packed = F.char_length(ends), F.lit(0)
    for i, c in enumerate(COMMON):
        count = (size - F.char_length(F.replace(ends, F.lit(c), F.lit("")))).bitwiseAND(F.lit(7))
        packed = packed.bitwiseOR(F.shiftleft(count, 3 * i))
    return packed


def alike(a: Column, b: Column, edits: int) -> Column:
    """Whether two spectra, the last 24 bits of a and b, allow for lines within `edits` edits: counts
    differ by no less than they do modulo 8, the shorter way round."""
    lane = lambda x, i: F.shiftright(x, 3 * i).bitwiseAND(F.lit(7).cast("long"))
    apart = [4 - F.abs(4 - F.abs(lane(a, i) - lane(b, i))) for i in range(len(COMMON))]
    return sum(apart[1:], apart[0]) <= 2 * edits


def near(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two lines are within `edits` edits, counted in characters."""
    return F.levenshtein(a, b, edits) >= 0


def lines_of(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, th, no (from 0), line, id: the lines of at least `shortest` characters."""
    return (
        docs.select("doc_id", F.xxhash64("text").alias("th"),
                    F.posexplode(F.split("text", "\n")).alias("no", "line"))
        .where(F.char_length("line") >= shortest).withColumn("id", F.xxhash64("line"))
    )


def links(lines: DataFrame, again: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(a, b): ids of different lines (id, line) within `edits` edits, each pair once. `again` has the
    ids that occur more than once.

    Texts stay where they are. Each line's signatures, 40 bits beside the 24 of its spectrum, are
    stored with its number: numbers of neighbours differ in their last bytes only, so they shuffle
    in less room than hashes. Copies are combined: a line that stands in a third of all documents
    has its signatures once. The signatures a line is indexed under are dealt once for both of the
    joins, whose conditions compare spectra, so that few pairs come out; texts are looked up for
    those only. Near copies of one long line differ where spectra don't look: signatures that very
    many lines are indexed under are left to a join that has the texts of these lines.
    """
    each = marked(lines.select("id", "line"), F.col("id"), again, "copied")
    each = signed(each.withColumn("no", F.monotonically_increasing_id()), edits, shortest)
    with methods_split(lines.sparkSession):
        each = materialize(each, "signed")
    copies = materialize(
        each.where("copied").groupBy("id", "own", "more").agg(F.min("no").alias("no")), "copies")
    known = each.where("not copied").select("id", "no", "own", "more").unionByName(copies)

    own, more = (known.select("no", F.explode(c).alias("x")).where("x is not null") for c in ("own", "more"))
    sig = F.shiftright("x", BAG)
    crowded = own.where(F.pmod(F.xxhash64("no"), F.lit(ONE_IN)) == 0).groupBy(sig.alias("sig")).count()
    crowded = materialize(crowded.where(F.col("count") >= MANY).select("sig"), "crowded")

    def met(a: DataFrame, b: DataFrame, apart: Column) -> DataFrame:
        same = F.shiftright("a.x", BAG) == F.shiftright("b.x", BAG)
        return a.alias("a").join(b.alias("b"), same & apart & alike(F.col("a.x"), F.col("b.x"), edits))

    def either(own: DataFrame, more: DataFrame, *found: Column, close: Column = F.lit(True)) -> DataFrame:
        """Of all that meet and are `close`."""
        return met(own, own, (F.col("a.no") < F.col("b.no")) & close).select(*found).union(
            met(own, more, (F.col("a.no") != F.col("b.no")) & close).select(*found)).distinct()

    busy = None
    if not crowded.isEmpty():
        few = small_side(crowded)
        busy = [materialize(df.join(few, sig == F.col("sig"), "left_semi"), "busy") for df in (own, more)]
        own = own.join(few, sig == F.col("sig"), "left_anti")  # so the rest of `more` meets none of them
    pairs = materialize(
        either(own, more, F.least("a.no", "b.no").alias("a"), F.greatest("a.no", "b.no").alias("b")), "pairs")
    numbers = pairs.select(F.explode(F.array("a", "b")).alias("no"))
    for df in busy or []:
        numbers = numbers.union(df.select("no"))
    numbers = numbers.distinct()
    # Not semi-joins, which the optimizer would put below the bitmap.
    hashes = materialize(
        narrowed(known.select("no", "id"), F.col("no"), numbers).join(numbers, "no"), "hashes")
    texts = narrowed(lines.select("id", "line"), F.col("id"), hashes.select("id")).distinct()
    texts = materialize(texts.join(hashes, "id"), "texts")
    of_a = texts.select(F.col("no").alias("a"), F.col("id").alias("hash_a"), F.col("line").alias("line_a"))
    of_b = texts.select(F.col("no").alias("b"), F.col("id").alias("hash_b"), F.col("line").alias("line_b"))
    found = pairs.join(of_a, "a").join(of_b, "b").where(near(F.col("line_a"), F.col("line_b"), edits)).select(
        F.least("hash_a", "hash_b").alias("a"), F.greatest("hash_a", "hash_b").alias("b"))
    if busy:
        found = found.union(either(
            *[df.join(texts, "no") for df in busy],
            F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"),
            close=near(F.col("a.line"), F.col("b.line"), edits)))
    return found.distinct()


def repeated(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, th, gone: the places of each document's lines that repeat an earlier one."""
    lines = lines_of(docs, shortest)
    places = materialize(lines.select("doc_id", "th", "no", "id"), "places")
    again = materialize(places.groupBy("id").count().where("count > 1").select("id"), "again")
    roots = connected(links(lines, again, edits, shortest), "lines")
    # The other lines are alone in their class.
    places = materialize(
        narrowed(places, F.col("id"), again.union(roots.select(F.col("node").alias("id")))), "shared")
    firsts = places.groupBy("id").agg(
        F.min(F.struct("doc_id", "th", "no")).alias("first"), F.count("*").alias("n"))
    of = firsts.join(roots, F.col("id") == F.col("node"), "left").where(
        "n > 1 or node is not null").select("id", "first", F.coalesce("root", "id").alias("root"))
    of = materialize(of, "classes")
    kept = of.groupBy("root").agg(F.min("first").alias("kept"))
    of = of.join(kept, "root").select("id", "kept")
    return (
        places.join(of, "id")
        .where(~F.struct("doc_id", "th", "no").eqNullSafe(F.col("kept")))
        .groupBy("doc_id", "th").agg(F.collect_set("no").alias("gone"))
    )


def clean(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text, …), repeated lines taken out of `text`; adds
    `__lines` and `__gone`, the numbers of lines before and lost, in place of columns of such names."""
    docs = docs.drop("__lines", "__gone")
    d, x, g, m = (free(docs, stem) for stem in "dxgm")
    gone = materialize(repeated(docs, edits, shortest), "gone").select(
        F.col("doc_id").alias(d), F.col("th").alias(x), F.col("gone").alias(g))
    # Only the documents that lose lines, and a few others, move.
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    each = marked(docs, key, gone.select(F.xxhash64(d, x)), m)
    stay = _without(each.where(~F.col(m)).withColumn(g, F.lit(None).cast("array<int>")), docs.columns, g)
    # The smaller side is hashed: sorting would move every text once more.
    both = each.where(m).join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(d))
                              & (F.xxhash64("text") == F.col(x)), "left")
    return stay.unionByName(_without(both, docs.columns, g))


def _without(docs: DataFrame, columns: list[str], g: str) -> DataFrame:
    """`clean`'s columns, of documents with the numbers of the lines that go in column `g`."""
    # A column of its own: in the lambda, the text would be split again for each line.
    p = free(docs, "p")
    docs, parts = docs.withColumn(p, F.split("text", "\n")), F.col(p)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(g))
    text = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    return docs.select(
        *[F.when(F.col(g).isNull(), F.col("text")).otherwise(text).alias("text")
          if c == "text" else F.col(f"`{c}`") for c in columns],
        F.when(F.col("text").isNotNull(), F.size(parts)).cast("long").alias("__lines"),
        F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long").alias("__gone"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines, lines lost, and a digest of the text that stays."""
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.coalesce("__lines", F.lit(0)).cast("long").alias("n_lines"),
        F.col("__gone").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}

ORACLES = {"op6_line_dedup": f"""
WITH RECURSIVE
l AS (SELECT doc_id, no, line, count(*) OVER (PARTITION BY doc_id) AS n_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(len(string_split(text, chr(10))))) AS no FROM documents)),
-- levenshtein() counts bytes, so other characters stand for those beyond ASCII.
odd AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[^\\x00-\\x7F]')) AS ch FROM l),
spell AS (SELECT string_agg(ch, '' ORDER BY ch) AS ch, string_agg(chr(k), '' ORDER BY ch) AS sign
          FROM (SELECT ch, CAST(row_number() OVER (ORDER BY ch) AS INTEGER) AS k FROM odd)),
d AS (SELECT line, length(line) AS n, translate(line, coalesce(ch, ''), coalesce(sign, '')) AS s
      FROM (SELECT DISTINCT line FROM l WHERE length(line) >= {SHORTEST}), spell),
e AS (SELECT a.line AS a, b.line AS b FROM d a JOIN (
        SELECT *, unnest(range(n - {EDITS}, n + {EDITS} + 1)) AS near FROM d) b ON a.n = b.near
      WHERE a.line <> b.line AND levenshtein(a.s, b.s) <= {EDITS}),
reach AS (SELECT line AS a, line AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
class AS (SELECT a AS line, min(b) AS root FROM reach GROUP BY a),
seen AS (SELECT doc_id, no, row_number() OVER (PARTITION BY root ORDER BY doc_id, no) > 1 AS gone
         FROM l JOIN class USING (line)),
kept AS (
  SELECT doc_id, any_value(n_lines) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (gone IS NOT TRUE), '') AS text
  FROM l LEFT JOIN seen USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       sha256(text) AS text_sha256
FROM kept
"""}
