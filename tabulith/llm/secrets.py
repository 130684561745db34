"""Spans of secrets in texts: fixed patterns, and random strings by token efficiency.

A tokenizer's merges fit words, so a word needs few tokens for its characters and a random string
needs many. A run of 20 or more characters of the base64 alphabets is reported as `random` if it
has under 2.1 characters per token of a tiktoken vocabulary, whether or not a fixed pattern has
found it too. Left out are known digests (listed values, and hexadecimal runs of a digest's length
right after a word that names one), UUIDs, and identifiers (words and numbers with signs between,
a word being written in one case but for its first letter).

On the test documents the token test alone finds all values of assigned secrets, which have 1.3 to
2.0 characters per token, and no other run of that length, which have 2.2 and more; the tests hold
it to 0.9 of the former and a hundredth of clean documents.

NULL texts count as empty and have no spans; repeated rows are judged alike; an empty table gives
no rows. Extra columns of the input are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulith.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
CHARS_PER_TOKEN, SHORTEST = 2.1, 20
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run either is long enough as a whole or fails
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
#: Characters of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal digits.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST_WORD = re.compile(
    r"""(?:md5|sha-?(?:1|224|256|384|512)|sha|digest|checksum|etag|commit|integrity)(?:sum)?["']?\s{0,2}[:=]?\s{0,2}["']?$""",
    re.IGNORECASE)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PART = r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"
IDENTIFIER = re.compile(rf"[+/_=-]*{PART}(?:[+/_=-]+{PART})+[+/_=-]*|[+/_=-]+{PART}?")

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding of a file of ranks, read once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; kind is a place in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def known_digest(text: str, start: int, run: str, listed: frozenset[str] = frozenset()) -> bool:
    """Whether a run that begins at `start` is a listed value, or named as a digest before it."""
    if run.lower() in listed:
        return True
    return (len(run) in DIGEST_LENGTHS and bool(HEXADECIMAL.fullmatch(run))
            and bool(DIGEST_WORD.search(text[max(0, start - 24):start])))


def random_spans(text: str, path: str, ratio: float = CHARS_PER_TOKEN,
                 listed: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """The runs that the token test reports."""
    found = []
    for m in RUN.finditer(text):
        run = m[0]
        if UUID.fullmatch(run) or IDENTIFIER.fullmatch(run) or known_digest(text, m.start(), run, listed):
            continue
        if len(run) < ratio * len(encoding(path).encode_ordinary(run)):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, path: str | None = None, ratio: float = CHARS_PER_TOKEN,
         listed: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points, end exclusive. `listed`
    are known digests in lower case, a list that the caller holds in memory."""
    path = path or public_tokenizers.path(VOCABULARY)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                spans = sorted(base_spans(text or "") + random_spans(text or "", path, ratio, listed))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        find, "doc_id long, spans array<struct<kind string, start long, end long>>")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of all documents, with counts and a digest of those by fixed patterns."""
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLES: dict[str, str] = {}
