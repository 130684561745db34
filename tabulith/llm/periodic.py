"""Periodic runs of words by multi-scale minimizers.

A run is a longest stretch of words with smallest period q of at least 4 q (and 6) words. For the
scale of periods from 2^s + 1 to 2^(s+1), each place has the hash of its 2^(s+1) words, and the
places whose hash is smallest in some window of 2^s places are kept. Inside a run of such a period
those hashes differ within a period and repeat from one to the next, and two whole windows a period
apart lie in the run; so some kept hash comes back exactly one period later, with no equal one
between. Hence neighbouring equal kept hashes at a distance of the scale seed every run; a seed is
extended word by word in both directions. Periods up to 8 are too short for windows: there each
lag is compared directly. A seed's period that is a multiple of a smaller one is left to that one
(two periods of so long a stretch have their greatest common divisor as a period).

Texts are worked on in batches of about a quarter of a million words, with a mark between texts
that equals no word; a longer text is a batch of its own. Nothing is shuffled.

NULL and empty texts have no words and no runs. A NULL doc_id plants nothing. Repeated rows are
judged each by its own. An empty table gives no rows. Extra columns are not carried. Of runs with
the same greatest exponent that with the smallest start, then period, is reported.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulith.llm.common import table, word_pieces

SHORT, EXPONENT, LEAST, BATCH_WORDS = 8, 4, 6, 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)
Run = tuple[int, int, int]  # start, length, period


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _least(a: np.ndarray, width: int, largest: bool = False) -> np.ndarray:
    """The smallest (largest) of each `width` neighbours, in two passes over pieces of that width."""
    if len(a) < width:
        return a[:0]
    best = np.maximum if largest else np.minimum
    fill = np.zeros(-len(a) % width, a.dtype) if largest else np.full(-len(a) % width, np.iinfo(a.dtype).max, a.dtype)
    x = np.concatenate([a, fill]).reshape(-1, width)
    before = best.accumulate(x, axis=1).ravel()
    after = best.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[:len(a) - width + 1], before[width - 1:len(a)])


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """The places whose hash is smallest in one of the windows they are in."""
    low = _least(hashes, window)
    if not len(low):
        return np.empty(0, np.int64)
    edge = np.zeros(window - 1, hashes.dtype)
    return np.flatnonzero(_least(np.concatenate([edge, low, edge]), window, largest=True) == hashes)


def _primitive(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether the first `period` words are no repetition of fewer."""
    word, rest, prime = ids[start:start + period], period, 2
    while rest > 1:
        if rest % prime == 0:
            while rest % prime == 0:
                rest //= prime
            lag = period // prime
            if (word[lag:] == word[:-lag]).all():
                return False
        prime += 1
    return True


def _same(ids: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many words from a and b on (step 1) or backwards (-1) are equal, `most` at most."""
    done, size = 0, 64
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differs = ids[a + done:a + done + n] != ids[b + done:b + done + n]
        else:
            differs = (ids[a - done - n + 1:a - done + 1] != ids[b - done - n + 1:b - done + 1])[::-1]
        at = int(differs.argmax())
        if differs[at]:
            return done + at
        done, size = done + n, size * 2
    return done


def runs(ids: np.ndarray, longest: int | None = None) -> list[Run]:
    """All runs of a sequence of numbers, by start and period; none is longer than `longest`."""
    n, found = len(ids), []
    longest = n if longest is None else longest
    for q in range(1, min(SHORT, longest // EXPONENT) + 1):
        equal = np.zeros(n - q + 2, np.int8)
        equal[1:-1] = ids[q:] == ids[:-q]
        turns = np.diff(equal)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        for i in np.flatnonzero(ends - starts + q >= max(LEAST, EXPONENT * q)):
            start = int(starts[i])
            if _primitive(ids, start, q):
                found.append((start, int(ends[i]) - start + q, q))
    with np.errstate(over="ignore"):
        hashes, width, window = _mixed(ids.astype(np.uint64) * ODD), 1, SHORT
        while EXPONENT * (window + 1) <= longest:
            while width < 2 * window:  # hashes of twice as many words
                hashes = _mixed(hashes[:-width] * ODD + hashes[width:])
                width *= 2
            kept = minimizers(hashes, window)
            order = kept[np.argsort(hashes[kept], kind="stable")]
            step = np.diff(order)
            seeds = np.flatnonzero((hashes[order[1:]] == hashes[order[:-1]]) & (step > window) & (step <= 2 * window))
            done = (0, -1)  # period, and the end of the last stretch with it
            for q, at in sorted(zip(step[seeds].tolist(), order[seeds].tolist())):
                if done[0] == q and at < done[1]:
                    continue
                start = at - _same(ids, at - 1, at + q - 1, -1, at)
                end = at + q + _same(ids, at, at + q, 1, n - at - q)
                done = (q, end - q)
                if end - start >= EXPONENT * q and _primitive(ids, start, q):
                    found.append((start, end - start, q))
            window *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words of a tenth of the documents, chosen by id, repeat from some place on."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(ids)
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = ids.copy()
    out[a:] = ids[a + np.arange(n - a) % p]
    return out


def _joined(names: list[bytes], ids: np.ndarray) -> str:
    """SHA-256 of the words joined by a space."""
    digest = hashlib.sha256()
    for i in range(0, len(ids), 1 << 16):
        digest.update(b" " * (i > 0) + b" ".join(map(names.__getitem__, ids[i:i + (1 << 16)].tolist())))
    return digest.hexdigest()


COLUMNS = ("n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def describe(names: list[bytes], ids: np.ndarray, found: list[Run]) -> tuple:
    """The columns of a document with the given words and runs."""
    best = None
    keep = np.ones(len(ids), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *best, hashlib.sha256(listed.encode()).hexdigest(),
            _joined(names, ids[keep] if found else ids))


def _batch(texts: list[np.ndarray], names: list[bytes]) -> Iterator[tuple]:
    """The columns of each of some texts (numbers of their words)."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    line = np.full(int(starts[-1]), -1, np.int64)
    for i, t in enumerate(texts):
        line[starts[i]:starts[i] + len(t)] = t
        line[starts[i] + len(t)] = -1 - i  # after each text a mark of its own
    found: list[list[Run]] = [[] for _ in texts]
    for start, length, period in runs(line, max(map(len, texts), default=0)):
        i = int(np.searchsorted(starts, start, side="right")) - 1
        found[i].append((start - int(starts[i]), length, period))
    for t, f in zip(texts, found):
        yield describe(names, t, f)


def find(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id and the columns of COLUMNS for each row of documents (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        texts: list[np.ndarray] = []
        size = 0
        vocabulary: dict[bytes, int] = defaultdict(lambda: len(vocabulary))

        def close() -> pa.RecordBatch:
            nonlocal size
            columns = [list(c) for c in zip(*_batch(texts, list(vocabulary)))] or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]])
            keys.clear(), texts.clear(), vocabulary.clear()
            size = 0
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                parts = [np.fromiter(map(vocabulary.__getitem__, p), np.int64, len(p)) for p in word_pieces(raw)]
                ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
                keys.append(doc_id)
                texts.append(planted(ids, doc_id) if plant else ids)
                size += len(ids)
                if size >= BATCH_WORDS or len(keys) >= 4096:
                    yield close()
        if keys:
            yield close()

    return rows.mapInArrow(run, f"doc_id long, {COLUMNS}")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, with the planted ones."""
    return find(table(spark, sf_dir, "documents"), plant=True)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}

#: Places with the same five words at any distance up to a quarter of the text: a run has five at
#: least that repeat a period later.
ORACLES = {"op12_periodic_runs": f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_prepend(i, range(8)),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT rid, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(regexp_extract_all(hex(CAST(doc_id AS VARCHAR)), '..'),
                                                lambda b: CAST('0x' || b AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
      FROM d, crc),
p AS (SELECT rid, doc_id, w, coalesce(h % 10 = 0 AND len(w) > 0, false) AS hit, h // 10 AS g,
             CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a
      FROM d JOIN h USING (rid)),
x AS (SELECT rid, doc_id, CASE WHEN hit THEN list_concat(w[:a], list_transform(
        range(len(w) - a), lambda i: w[a + i % (1 + (len(w) - a) // (3 + g % 8)) + 1])) ELSE w END AS w
      FROM p),
words AS (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS word FROM x),
fives AS (SELECT rid, i, len(w) // {EXPONENT} AS most, array_to_string(w[i + 1:i + 5], ' ') AS five
          FROM (SELECT rid, w, unnest(range(len(w) - 4)) AS i FROM x WHERE len(w) > 4)),
same AS (SELECT a.rid, b.i - a.i AS q, a.i FROM fives a JOIN fives b
         ON a.rid = b.rid AND a.five = b.five AND a.i < b.i AND b.i - a.i <= a.most),
islands AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM same),
found AS (SELECT rid, q, min(i) AS s, count(*) + 4 + q AS n FROM islands GROUP BY rid, q, island
          HAVING count(*) + 4 + q >= greatest({LEAST}, {EXPONENT} * q)),
runs AS (SELECT * FROM found r WHERE NOT EXISTS (
           SELECT 1 FROM found f WHERE f.rid = r.rid AND f.q < r.q AND f.s <= r.s AND f.s + f.n >= r.s + r.n)),
best AS (SELECT rid, s, n, q FROM (
           SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n / q::DOUBLE DESC, s, q) AS k FROM runs) WHERE k = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t
           FROM runs GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM words w WHERE NOT EXISTS (
           SELECT 1 FROM runs r WHERE r.rid = w.rid AND w.i >= r.s + r.q AND w.i < r.s + r.n) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, n AS length, q AS period,
       1000 * n // q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256,
       sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM x LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""}
