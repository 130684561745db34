"""Near-duplicates by MinHash bands, with odd sketches between candidates and the exact check.

A document's set is its distinct 5-word shingles. 160 MinHash samples of it make 32 bands of 5.
1024 more, the smallest hash of each part of the hash range that has any (one-permutation MinHash),
make an odd sketch: each sample flips one of 2048 bits, so that the population count of the XOR of
two sketches gives the number of samples that differ. Documents with equal sets are one node from
then on.

1. Nodes that share a band meet. Each picks the one that looks most like it, if that looks alike
   in 0.85, and these pairs, at most one per node, are checked on the full sets. The confirmed ones
   give components; a second round does the same between components.
2. What is left undecided, nodes that meet in a band, are in different components and may be alike
   in 0.85 as far as sizes and sketches tell, meets once more with the full sets: under a band,
   pairs are checked from the likeliest on, each under its first common band only, until they are
   refuted or connected. No pairs are written, only the links found, fewer than nodes.

A pair at 0.85 shares no band with probability (1 - 0.85^5)^32 = 7e-9; "may be" leaves six standard
deviations of the samples and of the sketch. Every link that is used was confirmed on the full
sets, which are worked out again for the nodes in question only. Nodes under one band are dealt
into blocks; a task holds two blocks.

NULL and empty texts and those of white space have the empty set: linked with nothing, a component
of their own. Equal ids are judged each by its own text. A NULL id is never a component's smallest
one unless all are NULL. An empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulith.llm.common import connected, materialize, narrowed, table, word_pieces

SHINGLE, PERCENT = 5, 85
BANDS, ROWS, PARTS, BITS = 32, 5, 1024, 2048
SIGMAS, BLOCK = 6.0, 1024
SAMPLES = BANDS * ROWS
U64 = np.uint64
_random = np.random.default_rng(13)
FACTORS = _random.integers(0, 1 << 63, SAMPLES, np.uint64) * U64(2) + U64(1)
SHIFTS = _random.integers(0, 1 << 63, SAMPLES, np.uint64)


class _Hashes(dict):
    """The hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 19:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: str | None, known: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order; of all words if those are fewer."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    parts = [np.fromiter(map(known.__getitem__, p), np.uint64, len(p)) for p in word_pieces(raw)]
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    n = min(size, len(words))
    if not n:
        return words
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mixed(out * U64(0x9E3779B97F4A7C15) + words[i:len(words) - n + 1 + i])
    return np.unique(out)


def samples(found: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the hash functions."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 512):
            low = np.minimum(low, (found[i:i + 512] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1))
    return low


def firsts(found: np.ndarray) -> np.ndarray:
    """The smallest hash in each of the equal parts of the range of hashes that has any."""
    part = found >> U64(64 - PARTS.bit_length() + 1)
    return found[np.concatenate([[True], part[1:] != part[:-1]])] if len(found) else found


def sketch(picked: np.ndarray) -> np.ndarray:
    """The parity of the samples that fall on each bit."""
    with np.errstate(over="ignore"):
        bit = _mixed(picked * U64(0x9E3779B97F4A7C15)) % U64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(np.uint8))


def likeness(size: np.ndarray, other: int, count: np.ndarray, others: int, differ: np.ndarray,
             similarity: float, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """How alike sets of `size` and `other` elements look, `count` and `others` samples of which
    have sketches that differ in so many bits: samples in common as a share of those expected at
    the given similarity; and whether they may reach it, some standard deviations granted."""
    union = (size + other) / (1 + similarity)
    # Parts that one of the sets has samples in: those of one, and those that the other's own
    # elements open.
    tried = np.minimum(count + np.maximum(0, union - size) * (1 - count / PARTS),
                       others + np.maximum(0, union - other) * (1 - others / PARTS))
    apart = np.log1p(-2 * np.minimum(differ, BITS / 2 - 1) / BITS) / np.log1p(-2 / BITS)
    decay = np.exp(-4 * apart / BITS)
    of_sketch = np.maximum(0, BITS / 4 * (1 - decay) - apart * decay) / decay / 4
    of_samples = tried * similarity * (1 - similarity) * np.maximum(0, union - tried) / np.maximum(1, union - 1)
    shared = (count + others - apart) / 2
    # Few parts with two hashes, or few bits hit twice, are no normal distribution: a floor for that.
    room = sigmas * np.sqrt(of_sketch + of_samples + 0.25)
    fits = np.minimum(size, other) >= similarity * np.maximum(size, other) - 1e-9
    return shared / np.maximum(tried, 1), fits & (shared + room >= similarity * tried)


def _digest(found: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; NULL if empty), bands, sketch, n_samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                size, node, bands, bits, count = [], [], [], [], []
                for text in b.column(1):
                    found = shingles(text.as_py(), known)
                    size.append(len(found))
                    node.append(_digest(found))
                    if len(found):
                        low = samples(found)
                        with np.errstate(over="ignore"):
                            key = np.zeros(BANDS, np.uint64)
                            for r in range(ROWS):
                                key = _mixed(key * U64(0x9E3779B97F4A7C15) + low[r::ROWS])
                        bands.append(key.view(np.int64))
                        picked = firsts(found)
                        bits.append(sketch(picked).tobytes())
                        count.append(len(picked))
                    else:
                        bands.append(None), bits.append(None), count.append(0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size, pa.int64()), pa.array(node, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary()),
                     pa.array(count, pa.int64())],
                    ["doc_id", "n_shingles", "node", "bands", "sketch", "n_samples"])

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_shingles long, node binary, bands array<long>, sketch binary, n_samples long")


def _sets(docs: DataFrame) -> DataFrame:
    """node and shingles of each row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                found = [x for t in whole.column(1).slice(i, 256) if len(x := shingles(t.as_py(), known))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(x) for x in found], pa.binary()),
                     pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "shingles"])

    return _texts(docs).mapInArrow(run, "node binary, shingles array<long>")


def _met(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, i, j, own, band, node: the rows of each unit of work, a pair of blocks (`own` is the
    row's) under one band's value."""
    entries = nodes.select("node", F.posexplode("bands").alias("band", "value")).select(
        "node", "band", F.xxhash64("band", "value").alias("key"))
    # Counted by partial aggregates and joined back: no task holds all rows of a band's value.
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(
        F.least(i, F.col("own")).cast("long").alias("i"), F.greatest(i, F.col("own")).cast("long").alias("j")))
    return met.select("key", "own", "band", "node", F.explode(units).alias("u")).select(
        "key", "u.i", "u.j", "own", "band", "node")


class _Unit:
    """The rows of one unit, in the order of their nodes."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(held)
        node = t.column("node").to_pylist()
        order = sorted(range(len(node)), key=node.__getitem__)
        self.rows = t.take(pa.array(order, pa.int64()))
        self.node = [node[k] for k in order]
        self.bits = np.frombuffer(b"".join(self.rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        label = [x or n for x, n in zip(self.rows.column("label").to_pylist(), self.node)]
        names = {x: k for k, x in enumerate(dict.fromkeys(label))}
        self.label = np.array([names[x] for x in label])
        self.size, self.count, self.own = (
            self.rows.column(c).to_numpy() for c in ("n_shingles", "n_samples", "own"))
        # Two blocks of one value meet here to compare each with the other, not with itself.
        self.apart = self.rows.column("i")[0].as_py() != self.rows.column("j")[0].as_py()

    def others(self, at: int, after: int = 0) -> np.ndarray:
        """The rows that row `at` is to be compared with, from `after` on."""
        fits = self.label[after:] != self.label[at]
        if self.apart:
            fits &= self.own[after:] != self.own[at]
        return after + np.flatnonzero(fits)

    def looks(self, at: int, rest: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of `rest` that may be alike, and how alike they look."""
        differ = np.bitwise_count(self.bits[rest] ^ self.bits[at]).sum(1)
        share, near = likeness(self.size[rest], self.size[at], self.count[rest], self.count[at], differ,
                               PERCENT / 100, sigmas)
        return rest[near], share[near]


_KINDS = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def _per_unit(rows: DataFrame, work, schema: str) -> DataFrame:
    """`work(unit)` gives the result rows of each unit of work."""
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the unit being read: two blocks at most

        def close() -> list[tuple]:
            unit = _Unit(held) if sum(b.num_rows for b in held) > 1 else None
            held.clear()
            return list(work(unit)) if unit else []

        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], _KINDS[k]) for i, (_, k) in enumerate(fields)],
                [name for name, _ in fields])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), b.num_rows]
            found = []
            for a, z in zip(cuts, cuts[1:]):
                if held and tuple(held[0].column(i)[0].as_py() for i in range(3)) != tuple(keys[:, a]):
                    found += close()
                held.append(b.slice(a, z - a))
            yield batch(found)
        if held:
            yield batch(close())

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = ["key", "i", "j"]
    rest = [c for c in rows.columns if c not in first]
    return rows.select(*first, *rest).repartition(n, *first).sortWithinPartitions(*first).mapInArrow(run, schema)


def _nearest(unit: _Unit) -> Iterator[tuple]:
    """For each row the one of another component that looks most like it, if that looks alike."""
    for at in range(len(unit.node)):
        near, share = unit.looks(at, unit.others(at), 0.0)
        if len(near):
            k = int(share.argmax())
            yield unit.node[at], unit.node[near[k]], float(share[k])


def _undecided(unit: _Unit) -> Iterator[tuple]:
    """The rows that may be alike with one of another component."""
    if (unit.label == unit.label[0]).all():
        return
    open_ = np.zeros(len(unit.node), bool)
    for at in range(len(unit.node) - 1):
        near, _ = unit.looks(at, unit.others(at, at + 1), SIGMAS)
        open_[near] = True
        open_[at] |= len(near) > 0
    cols = [unit.rows.column(c).to_pylist() for c in ("key", "i", "j", "own", "band", "node")]
    for at in np.flatnonzero(open_).tolist():
        yield tuple(c[at] for c in cols)


def _linked(unit: _Unit) -> Iterator[tuple]:
    """Links that connect the rows whose full sets are alike."""
    sets = [np.asarray(x, np.int64) for x in unit.rows.column("shingles").to_pylist()]
    bands = np.array(unit.rows.column("bands").to_pylist(), np.int64)
    band = unit.rows.column("band")[0].as_py()
    for at in range(len(sets) - 1):
        near, share = unit.looks(at, unit.others(at, at + 1), SIGMAS)
        if not len(near):
            continue
        # Under the first band that both have in common, once for each pair.
        first = (bands[near] == bands[at]).argmax(1) == band
        near, share = near[first], share[first]
        for k in near[np.argsort(-share, kind="stable")].tolist():
            if unit.label[k] == unit.label[at]:  # connected meanwhile
                continue
            common = len(np.intersect1d(sets[at], sets[k], assume_unique=True))
            if 100 * common >= PERCENT * (len(sets[at]) + len(sets[k]) - common):
                unit.label[unit.label == unit.label[k]] = unit.label[at]
                yield unit.node[at], unit.node[k]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The stored pairs whose sets have at least `percent` of their union in common."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root): components of the nodes of the stored `rows` (made by `_signed` of `docs`)
    that are linked with any other."""
    nodes = materialize(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.any_value(F.struct("bands", "sketch", "n_shingles", "n_samples")).alias("v"))
        .select("node", "doc_id", "v.*"), "nodes")
    met = materialize(_met(nodes), "met")
    looks = nodes.select("node", "sketch", "n_shingles", "n_samples")

    def sets_of(asked: DataFrame) -> DataFrame:
        """node, shingles of the nodes asked for, from the texts of one document each."""
        asked = materialize(asked.distinct(), "asked")
        whose = nodes.select("node", "doc_id").join(asked, "node", "left_semi").select(
            F.xxhash64("doc_id").alias("id"))
        texts = narrowed(docs.select("doc_id", "text"), F.xxhash64(F.col("doc_id").cast("long")), whose)
        return materialize(_sets(texts).join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")

    def labelled(df: DataFrame, roots: DataFrame | None) -> DataFrame:
        df = df.join(looks, "node")
        if roots is None:
            return df.withColumn("label", F.lit(None).cast("binary"))
        return df.join(roots.select("node", F.col("root").alias("label")), "node", "left")

    roots, links = None, nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for _ in range(2):
        best = _per_unit(labelled(met, roots), _nearest, "node binary, other binary, share double")
        best = best.groupBy("node").agg(F.max(F.struct("share", "other")).alias("m"))
        pairs = materialize(best.select(
            F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct(), "pairs")
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        links = links.union(materialize(confirmed(pairs, sets_of(asked)), "links"))
        roots = connected(links, "components")
    left = materialize(_per_unit(
        labelled(met, roots), _undecided, "key long, i long, j long, own int, band int, node binary"), "undecided")
    whole = labelled(left, roots).join(sets_of(left.select("node")), "node").join(nodes.select("node", "bands"), "node")
    rest = _per_unit(whole, _linked, "a binary, b binary")
    return connected(links.union(rest), "components")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of documents (doc_id, text)."""
    rows = materialize(_signed(docs), "signed")
    roots = classes(docs, rows)
    members = materialize(
        rows.select("doc_id", "n_shingles", "node").join(roots, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root")), "members")
    least = members.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return members.join(least, "root", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op13_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op13_odd_sketch_dedup": op13_odd_sketch_dedup}

ORACLES = {"op13_odd_sketch_dedup": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS sh
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
sets AS (SELECT rid, md5(string_agg(sh, chr(10) ORDER BY sh)) AS node, count(*) AS n FROM s GROUP BY rid),
nodes AS (SELECT node, min(rid) AS rid, any_value(n) AS n FROM sets GROUP BY node),
ns AS (SELECT nodes.node, nodes.n, sh FROM nodes JOIN s USING (rid)),
common AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c
           FROM ns a JOIN ns b ON a.sh = b.sh AND a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= {PERCENT} * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes
          UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT reach.a AS node, min(doc_id) AS component_id
          FROM reach JOIN sets ON sets.node = reach.b JOIN d USING (rid) GROUP BY reach.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles,
       CASE WHEN sets.node IS NULL THEN doc_id ELSE component_id END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN sets.node IS NULL THEN doc_id ELSE component_id END AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN sets USING (rid) LEFT JOIN least USING (node)
"""}
