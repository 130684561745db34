"""Harmonic packing of token pieces into sequences.

With capacity C, a piece of length n belongs to class j = C // n: it fits into a slot of C // j
tokens, and a sequence of the class takes exactly j pieces. Classes never mix, so a sequence is
known from a piece's number in its class alone: workers number pieces on their own (with a small
table of counts for where each begins) and no bin is ever searched.

Documents may be cut. A remainder that would leave more than 1/32 of its slot empty gives up a
piece that fills the next smaller slot to the brim, and the rest is looked at again; rests below
C / 16 tokens stay whole. So padding comes from under 1/32 of each slot, from the tokens that a
class's slots don't divide, and from one unfinished sequence per class.

NULL texts count as empty: their piece is the closing id 0 alone. Repeated rows are packed each on
its own; an empty table gives no pieces. Extra columns of the input are not carried.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabulith.llm.common import materialize, numbered, table

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"
END = np.zeros(1, "<u4").tobytes()

#: A single space between two other characters always begins a new unit of the vocabulary's own
#: splitting rule, so what stands between two such places has the same ids wherever it occurs.
BETWEEN = re.compile(r"(?<=\S)(?= \S)")
#: White space other than the space and the line break.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Marks the name of the first unit of a text.
FIRST = "\0"
#: The same vocabulary as ranks of a tiktoken encoding.
RANKS = "byte_bpe_50k.tiktoken"
#: Units whose ids a worker remembers (about 200 bytes each, so 80 MB, kept while the worker lives);
#: others are encoded each time they come.
REMEMBERED = 400_000
#: Units that the library is given at a time.
LINES = 4096


def _ranked(path: str):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids as the `tokenizers` library gives them, each distinct unit of a text encoded once per
    worker. Plain units, nearly all, are merged by tiktoken where the vocabulary's `ranks` are at
    hand: the same merges, in a quarter of the time. The library takes the others, and all
    without ranks."""

    _by_path: dict[tuple, Encoder] = {}

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, bytes] = {}
        self.most = REMEMBERED
        self.ranked = _ranked(ranks) if ranks else None
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    @classmethod
    def of(cls, path: str, ranks: str | None = None) -> Encoder:
        if (path, ranks) not in cls._by_path:
            cls._by_path[path, ranks] = cls(path, ranks)
        return cls._by_path[path, ranks]

    def units(self, text: str) -> list[str]:
        """Names of a text's units: FIRST and the unit for the first, for others the unit without
        its leading space."""
        if FIRST in text or (self.special and self.special.search(text)):
            return [FIRST + text]  # as a whole
        if "  " in text or "\n " in text or " \n" in text or OTHER_SPACE.search(text):
            first, *rest = BETWEEN.split(text)
            return [FIRST + first, *[u[1:] for u in rest]]
        out = text.split(" ")
        out[0] = FIRST + out[0]
        if out[-1] == "":  # the text ends with a space, which is no place to cut
            out.pop()
            last = out.pop()
            out.append(last + " ")
        return out if len(out) == 1 or out[0] != FIRST else [out[0] + " " + out[1], *out[2:]]

    def _encode(self, names: list[str]) -> dict[str, bytes]:
        """Ids of each unit. Units without line breaks pass many at a time, a line each: the
        breaks have an id that nothing else has, and change nothing in the units beside them."""
        plain, odd = [], []
        for u in names:
            ok = u[0] != FIRST and "\n" not in u and u == u.strip()
            (plain if ok and self.line is not None else odd).append(u)
        got = self.tokenizer.encode_batch_fast(
            [u[1:] if u[0] == FIRST else " " + u for u in odd], add_special_tokens=False)
        out = {u: np.array(e.ids, "<u4").tobytes() for u, e in zip(odd, got)}
        for i in range(0, len(plain), LINES):
            some = plain[i: i + LINES]
            line = " " + "\n ".join(some)
            if self.ranked:
                ids = np.array(self.ranked.encode_ordinary(line), "<u4")
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line)
            blob, starts = ids.tobytes(), (4 * np.append(0, ends + 1)).tolist()
            out.update(zip(some, [blob[a:b] for a, b in zip(
                starts, (4 * np.append(ends, len(ids))).tolist())], strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without closing id. The library is asked once,
        for the units of all texts that aren't known yet."""
        known, new = self.known, set()
        split = [self.units(text) for text in texts]
        for units in split:
            new.update(set(units).difference(known))
        fresh = self._encode(list(new))
        if len(known) < self.most:
            known.update((u, i) for u, i in fresh.items() if len(u) <= 64)
        return [_join(units, known, fresh) for units in split]


def _join(units: list[str], known: dict[str, bytes], fresh: dict[str, bytes]) -> bytes:
    try:
        return b"".join(map(known.__getitem__, units))
    except KeyError:  # some unit isn't remembered
        return b"".join([fresh[u] if u in fresh else known[u] for u in units])


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        slot = capacity // j
        if rest * 16 <= capacity or (slot - rest) * 32 <= slot:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


def _parts(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
           with_ids: bool = True, ranks: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids: the pieces of each document (doc_id,
    text), closing id included; `ids` is NULL unless asked for. `path` is a vocabulary file of
    the tokenizers library, `ranks` the same vocabulary for tiktoken, if there is one."""
    if path is None:
        path, ranks = public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, ranks)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        types = [pa.int64()] * 5

        def batch(rows, blobs):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            if not with_ids:
                return pa.RecordBatch.from_arrays(
                    [*cols, pa.nulls(len(rows), pa.list_(pa.int32()))], [*names, "ids"])
            flat = np.frombuffer(b"".join(blobs), "<i4")
            ends = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
            return pa.RecordBatch.from_arrays(cols, [*names, "ids"])

        for b in (part for whole in batches for part in _parts(whole)):
            rows, blobs, held = [], [], 0
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(texts)):
                ids += END
                total, start = len(ids) // 4, 0
                for n in cuts(total, capacity):
                    blob = ids[4 * start: 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(blob), total))
                    if with_ids:
                        blobs.append(blob)
                    start, held = start + n, held + n
                if held > 2_000_000:
                    yield batch(rows, blobs)
                    rows, blobs, held = [], [], 0
            if rows:
                yield batch(rows, blobs)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id (gapless from 0) and offset to pieces with doc_id, start, length and
    ids_crc32. `cut` should be a stored table."""
    shards = 4 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classed = cut.withColumn("class", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    ranked = numbered(classed, ["class"], F.pmod(F.xxhash64("doc_id"), F.lit(shards)), order, "rank")
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("class")).cast("long"))
    # Sequences of each class, then the first number of a class. A row per class.
    sizes = classed.groupBy("class").agg(F.count("*").alias("n")).select(
        "class", F.ceil(F.col("n") / F.col("class")).alias("bins"))
    before = Window.partitionBy(F.lit(0)).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("class", F.coalesce(F.sum("bins").over(before), F.lit(0)).alias("first"))
    earlier = (Window.partitionBy("class", "bin").orderBy("rank")
               .rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranked.join(F.broadcast(firsts), "class")  # at most `capacity` rows
        .withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))
        .withColumn("sequence_id", (F.col("first") + F.col("bin")).cast("long"))
        .drop("class", "rank", "bin", "first")
    )


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids: the padded token ids of each sequence, from placed pieces with `ids`."""
    got = placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))),
                              lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    whole = n.isin([2**i for i in range(capacity.bit_length())])
    padding = F.when(whole, F.lit(0)).otherwise(F.lit(capacity) - n)
    return got.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(0), padding)).alias("ids"))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Where every piece of every document lies; ids themselves can be had again by `pieces`."""
    rows = materialize(pieces(docs, capacity, path, with_ids=False, ranks=ranks).drop("ids"), "pieces")
    return place(rows, capacity)


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op8_harmonic_packing": op8_harmonic_packing}
ORACLES: dict[str, str] = {}
