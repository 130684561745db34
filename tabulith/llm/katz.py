"""A word bigram model with Katz backoff, counted and evaluated by block requests.

Model. Tokens are the words of a text and one closing token, which also stands before the first
word. With N training tokens and Good-Turing factors d(r) for counts r up to 5:

    P(w)     = d(c) * c / N                    for a word seen in training,
    P(other) = what these leave                for all other words together,
    P(w | h) = d(c) * c(h, w) / c(h)           for a pair seen in training,
             = backoff(h) * P(w)               otherwise; P(w) if h was never seen,

where backoff(h) is exactly what pairs leave over what their second words leave of P, so each
distribution sums to 1. Where nothing would be left (all counts above 5), 1 is added to the
divisor. If the counts of counts give no usable factors (small corpora), absolute discounting
takes their place, with n1 / (n1 + 2 n2).

Work. Texts are tokenised once, into blocks of 1.5 million tokens with codes of their own.
A block asks the table of words, dealt by hash, for the ids and counts of its distinct words; then
the table of pairs, dealt by first word, for the counts of its distinct pairs and what backoff
needs. Pairs of a first word with more than a bucket's fair share are dealt by both words. So
each table is counted and asked in one shuffle, a bucket's size follows from the number of
buckets, and a block's texts are then scored token by token from what came back. Arrays travel
packed. Both tables are stored (`words`, `pairs` in what `fit_and_score` returns).

NULL texts count as empty: a closing token alone. Texts of any length are cut into parts at block
ends and summed. Repeated rows and ids are scored each on its own. An empty table gives no rows.
Extra columns are not carried. Without any training row every word is `other`, with probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulith.llm.common import materialize, table

TOKENS, TOP = 1_500_000, 5
U64 = np.dtype("<u8")


def pack(a: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte by byte of equal place, compressed."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, kind=U64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(kind)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (runs without ASCII white space, A-Z lowered) and the close."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(b"\n")  # no word
    return np.fromiter(map(xxhash.xxh64_intdigest, w), U64, len(w))


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..TOP) from the counts of counts n[1..TOP + 1]; above TOP a count is taken as it is."""
    r = np.arange(1, TOP + 1, dtype=float)
    n = n.astype(float)
    if (n[1:] > 0).all():
        common = (TOP + 1) * n[TOP + 1] / n[1]
        if common < 1:
            d = ((r + 1) * n[2:] / (r * n[1:-1]) - common) / (1 - common)
            if (d > 0).all() and (d < 1).all():
                return np.concatenate([[0.0], d])
    off = np.clip(n[1] / (n[1] + 2 * n[2]), 0.1, 0.9) if n[1] else 0.5
    return np.concatenate([[0.0], (r - off) / r])


@dataclass
class Words:
    """What all tasks know of the unigram level: a few numbers."""

    total: int
    distinct: int
    d: np.ndarray
    left: float
    divisor: float

    @classmethod
    def of(cls, total: int, distinct: int, counted: np.ndarray) -> Words:
        d = discounts(counted)
        r = np.arange(TOP + 1)
        left = float(((1 - d) * r * counted[: TOP + 1])[1:].sum())
        divisor = float(total) if left > 0 else total + 1.0
        return cls(total, distinct, d, (left if left > 0 else 1.0) / divisor, divisor)

    def p(self, c: np.ndarray) -> np.ndarray:
        """P of a word with training count c (0: all other words)."""
        factor = np.where(c > TOP, 1.0, self.d[np.minimum(c, TOP).astype(int)])
        return np.where(c == 0, self.left, factor * c / self.divisor)


def _bytes(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.large_binary()).cast(pa.binary())


BLOCK = ("blk long, rows binary, ids binary, flags binary, lengths binary, before binary, "
         "codes binary, vocabulary binary, counts binary")


def _blocks(most: int):
    """Texts to blocks of `most` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        blk, parts, size = first, [], 0

        def close() -> pa.RecordBatch:
            rows, ids, flags, before, pieces = zip(*parts)
            stream = np.concatenate([*pieces, np.array(before, U64)])
            vocabulary, codes = np.unique(stream, return_inverse=True)
            codes = codes.reshape(-1).astype(U64)
            lengths = np.array([len(p) for p in pieces], U64)
            n = int(lengths.sum())
            learn = np.repeat(np.array(flags, U64) & np.uint64(1), lengths.astype(int)).astype(bool)
            counts = np.bincount(codes[:n][learn].astype(int), minlength=len(vocabulary)).astype(U64)
            fields = [np.array(rows, U64), np.array(ids, "<i8"), np.array(flags, U64), lengths, codes[n:],
                      codes[:n], vocabulary, counts]
            return pa.RecordBatch.from_arrays(
                [pa.array([blk], pa.int64()), *[_bytes([pack(f)]) for f in fields]],
                [c.split()[0] for c in BLOCK.split(", ")])

        end = tokens("")[0]
        row = 0
        for b in batches:
            for doc, text, learn in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "learn")]):
                stream, before = tokens(text), end
                # Flags: 1 to learn from, 2 no doc_id.
                flag, key, row = int(bool(learn)) | 2 * (doc is None), (first << 20) + row, row + 1
                while len(stream):
                    piece, stream = stream[: most - size], stream[most - size:]
                    parts.append((key, doc or 0, flag, before, piece))
                    before, size = piece[-1], size + len(piece)
                    if size >= most:
                        yield close()
                        blk, parts, size = blk + 1, [], 0
        if parts:
            yield close()
    return run


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash, ascending with it."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_requests(buckets: int):
    def run(batches):
        for b in batches:
            for blk, voc, n in zip(*[b.column(c).to_pylist() for c in ("blk", "vocabulary", "counts")]):
                voc, n = unpack(voc), unpack(n)
                at = np.searchsorted(_split(voc, buckets), np.arange(buckets + 1, dtype=U64))
                own = [i for i in range(buckets) if at[i] < at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), pa.array([blk] * len(own), pa.int64()),
                     _bytes([pack(voc[at[i]: at[i + 1]]) for i in own]),
                     _bytes([pack(n[at[i]: at[i + 1]]) for i in own])],
                    ["bucket", "blk", "words", "n"])
    return run


REPLY = ("kind string, bucket long, blk long, a binary, b binary, c binary, d binary, "
         "stats array<long>")


def _reply(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 8
    return pa.table(
        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
         *[_bytes(list(cols[i])) for i in range(3, 7)], pa.array(cols[7], pa.list_(pa.int64()))],
        [c.split()[0] for c in REPLY.split(", ")])


def _counted(c: np.ndarray) -> list[int]:
    """Total, distinct, and how many have each count from 0 to TOP + 1."""
    c = c[c > 0].astype(np.int64)
    return [int(c.sum()), len(c), *np.bincount(c[c <= TOP + 1], minlength=TOP + 2).tolist()]


def _count_words(buckets: int):
    """A bucket's table (a: words, b: counts; frequent words first, which gives the ids) and the
    ids and counts that each block asked for."""
    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        asked = [unpack(x) for x in t.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.zeros(len(words), U64)
        for i, n in zip(np.split(at.reshape(-1), np.cumsum([len(x) for x in asked])[:-1]),
                        t.column("n").to_pylist()):
            counts[i] += unpack(n)
        order = np.argsort(-counts.astype(np.int64), kind="stable")
        ids = np.empty(len(words), U64)
        ids[order] = np.arange(len(words), dtype=U64) * np.uint64(buckets) + np.uint64(bucket)
        out = [("words", bucket, -1, pack(words[order]), pack(counts[order]), None, None, _counted(counts))]
        for blk, x in zip(t.column("blk").to_pylist(), asked):
            i = np.searchsorted(words, x)
            out.append(("reply", bucket, blk, pack(ids[i]), pack(counts[i]), None, None, None))
        return _reply(out)
    return run


def _in_order(t: pa.Table, kind: str, *cols: str) -> list[tuple]:
    rows = [r for r in t.to_pylist() if r["kind"] == kind]
    return [tuple(r[c] for c in cols) for r in sorted(rows, key=lambda r: r["bucket"])]


def _pairs(block: dict, replies: pa.Table, hot: int, buckets: int):
    """What a block asks of the pairs: ids and counts of its words; for each token the places of
    its history, itself and their pair; the distinct pairs, in an order that `_cells` cuts."""
    got = _in_order(replies, "reply", "a", "b")
    ids = np.concatenate([unpack(a) for a, _ in got])
    counts = np.concatenate([unpack(b) for _, b in got])
    cur, lengths = unpack(block["codes"]), unpack(block["lengths"]).astype(int)
    starts = np.cumsum(lengths) - lengths
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[starts] = unpack(block["before"])
    learn = np.repeat(unpack(block["flags"]) & np.uint64(1), lengths).astype(bool)
    pairs, at = np.unique(prev << np.uint64(32) | cur, return_inverse=True)
    at = at.reshape(-1)
    n = np.bincount(at[learn], minlength=len(pairs))
    p, c = (pairs >> np.uint64(32)).astype(int), (pairs & np.uint64(0xFFFFFFFF)).astype(int)
    by = np.where(counts[p] >= hot, _mix(ids[p]) ^ ids[c], ids[p])
    bucket = _split(_mix(by), buckets)
    order = np.lexsort((ids[c], ids[p], bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return {"ids": ids, "counts": counts, "cur": cur.astype(int), "prev": prev.astype(int),
            "lengths": lengths, "starts": starts, "at": place[at], "p": p[order], "c": c[order],
            "n": n[order].astype(U64), "bucket": bucket[order]}


def _firsts(p: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, int)


def _pair_requests(hot: int, buckets: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            x = _pairs(block, replies, hot, buckets)
            for i in np.unique(x["bucket"]).tolist():
                s = slice(*np.searchsorted(x["bucket"], np.array([i, i + 1], U64)))
                p, c = x["ids"][x["p"][s]], x["ids"][x["c"][s]]
                at = _firsts(p)
                heads = np.stack([p[at], np.diff(np.append(at, len(p))).astype(U64),
                                  x["counts"][x["p"][s]][at]])
                out.append(("pairs", i, block["blk"], pack(heads.reshape(-1)), pack(c), pack(x["n"][s]),
                            pack(x["counts"][x["c"][s]]), None))
        return _reply(out)
    return run


def _count_pairs(words: Words, hot: int):
    """A bucket's table (a: first words, b: second, c: counts); for each block, the counts of its
    pairs (a), and for each first word (b: six numbers) how many pairs have each count up to TOP
    and the sum of P over the second words. First words dealt by both words have partial numbers
    here; these also come out as rows of their own."""
    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        cells = []
        for a, b, c, d in zip(*[t.column(x).to_pylist() for x in "abcd"]):
            heads = unpack(a).reshape(3, -1)
            cells.append((heads, np.repeat(np.arange(heads.shape[1]), heads[1].astype(int)),
                          unpack(b), unpack(c), unpack(d)))
        first = np.concatenate([h[0][r] for h, r, *_ in cells])
        size = np.concatenate([h[2][r] for h, r, *_ in cells])
        second, n, other = (np.concatenate([x[i] for x in cells]) for i in (2, 3, 4))
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])]))
        counts = np.add.reduceat(n[order], new)
        group = np.empty(len(order), np.int64)  # of each request, its distinct pair
        group[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        f, s, other, size = f[new], s[new], other[order][new], size[order][new]
        at = _firsts(f)
        seen = counts > 0
        stats = np.stack([*[np.add.reduceat((counts == r).astype(float), at) for r in range(1, TOP + 1)],
                          np.add.reduceat(np.where(seen, words.p(other), 0.0), at)])
        out = [("table", bucket, -1, pack(f[seen]), pack(s[seen]), pack(counts[seen]), None, _counted(counts))]
        big = size[at] >= hot
        if big.any():
            out.append(("hot", bucket, -1, pack(f[at][big]), pack(stats[:, big].reshape(-1)), None, None, None))
        done = 0
        for blk, (heads, r, *_) in zip(t.column("blk").to_pylist(), cells):
            mine = stats[:, np.searchsorted(f[at], heads[0])]
            out.append(("counts", bucket, blk, pack(counts[group[done: done + len(r)]]),
                        pack(np.ascontiguousarray(mine).reshape(-1)), None, None, None))
            done += len(r)
        return _reply(out)
    return run


SCORED = ("row long, doc_id long, learn boolean, n_tokens long, n_known long, base double, "
          "score double")


def _evaluate(words: Words, d: np.ndarray, hot: int, buckets: int, big: dict[int, np.ndarray]):
    """Scores of the parts of texts in a block. `big`: the whole numbers of hot first words."""
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            x = _pairs(block, replies, hot, buckets)
            got = _in_order(replies, "counts", "bucket", "a", "b")
            pair = np.concatenate([unpack(a) for _, a, _ in got])
            heads = np.concatenate([unpack(b, np.dtype("<f8")).reshape(TOP + 1, -1) for *_, b in got], 1)
            # Heads stand in the order of the requests: a new one with each bucket or first word.
            new = np.concatenate([[True], (x["p"][1:] != x["p"][:-1]) | (x["bucket"][1:] != x["bucket"][:-1])])
            h = heads[:, np.cumsum(new) - 1]
            size = x["counts"][x["p"]].astype(float)
            wide = np.flatnonzero(size >= hot)
            if len(wide):
                h[:, wide] = np.stack([big[int(i)] for i in x["ids"][x["p"][wide]]], axis=1)
            r = np.arange(1, TOP + 1)[:, None]
            left = ((1 - d[1:])[:, None] * r * h[:TOP]).sum(0)
            none = left <= 0
            divisor = np.where(none, size + 1, np.maximum(size, 1))
            left = np.where(none, 1.0, left) / divisor
            backoff = np.where(size > 0, left / (1 - h[TOP]), 1.0)
            factor = np.where(pair > TOP, 1.0, d[np.minimum(pair, TOP).astype(int)])
            single = words.p(x["counts"][x["c"]])
            p = np.where(pair > 0, factor * pair / divisor, backoff * single)
            count = x["counts"][x["cur"]]
            base = np.log10((count + 0.5) / (words.total + 0.5 * (words.distinct + 1)))
            sums = [np.add.reduceat(v, x["starts"]) for v in
                    ((count > 0).astype(np.int64), base, np.log10(p)[x["at"]])]
            flags = unpack(block["flags"])
            out.append(pa.table(
                [pa.array(unpack(block["rows"]).astype(np.int64)),
                 pa.array(unpack(block["ids"], np.dtype("<i8")), mask=(flags & np.uint64(2)) > 0),
                 pa.array((flags & np.uint64(1)) > 0), pa.array(x["lengths"].astype(np.int64)),
                 *map(pa.array, sums)], [c.split()[0] for c in SCORED.split(", ")]))
        return pa.concat_tables(out) if out else pa.schema([]).empty_table()
    return run


def _totals(rows: DataFrame) -> list[int]:
    """The sums of `stats`, a row of TOP + 4 numbers."""
    got = rows.agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(TOP + 4)]).first()
    return [int(v or 0) for v in got]


def fit_and_score(docs: DataFrame, learn: Column, block_tokens: int = TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of `docs` (doc_id, text), the model learned from the rows where `learn` holds: doc_id,
    learn, n_tokens, n_known, train_tokens, base_score, score. Also the stored tables: `words`
    (bucket, a: hashes, b: counts) and `pairs` (bucket, a: ids, b: ids, c: counts), packed; the id
    of the i-th word of a bucket is i times the number of buckets, plus the bucket."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), learn.alias("learn"))
    blocks = materialize(rows.mapInArrow(_blocks(block_tokens), BLOCK), "blocks")

    asked = blocks.select("blk", "vocabulary", "counts").mapInArrow(
        _word_requests(buckets), "bucket long, blk long, words binary, n binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_count_words(buckets), REPLY), "words")
    table_of_words = answers.where("kind = 'words'")
    total, distinct, *counted = _totals(table_of_words.select("stats"))
    words = Words.of(total, distinct, np.array(counted))
    # A first word is hot from a quarter of a bucket's fair share on: at most 4 per bucket.
    hot = max(1, total // (4 * buckets))

    texts = blocks.drop("vocabulary", "counts")
    replies = answers.where("kind = 'reply'").drop("stats")
    requests = texts.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(
        _pair_requests(hot, buckets), REPLY)
    found = materialize(requests.groupBy("bucket").applyInArrow(_count_pairs(words, hot), REPLY), "pairs")
    table_of_pairs = found.where("kind = 'table'")
    d = discounts(np.array(_totals(table_of_pairs.select("stats"))[2:]))
    big: dict[int, np.ndarray] = {}
    for r in found.where("kind = 'hot'").select("a", "b").toLocalIterator():
        values = unpack(bytes(r.b), np.dtype("<f8")).reshape(TOP + 1, -1)
        for i, v in zip(unpack(bytes(r.a)).tolist(), values.T):
            big[i] = big.get(i, 0.0) + v

    both = replies.union(found.where("kind = 'counts'").drop("stats"))
    parts = texts.groupBy("blk").cogroup(both.groupBy("blk")).applyInArrow(
        _evaluate(words, d, hot, buckets, big), SCORED)
    scores = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("learn").alias("learn"),
        F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"),
        F.sum("score").alias("score")).drop("row")
    return scores, table_of_words, table_of_pairs


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those outside the held-out fifth."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held_out = F.crc32(key) % 5 == 1
    scores, _, _ = fit_and_score(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


QUERIES = {"op9_katz_scoring": op9_katz_scoring}
ORACLES: dict[str, str] = {}
