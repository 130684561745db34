"""op6: what moves and what the filter before the texts lets through."""

import hashlib
import random

from pyspark.sql import functions as F

from tabulith.llm import linededup


def test_only_texts_of_met_lines_are_stored(spark, monkeypatch):
    stored, write = {}, linededup.materialize

    def seen(df, label):
        out = write(df, label)
        stored[label] = (out.columns, out.count())
        return out

    monkeypatch.setattr(linededup, "materialize", seen)
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(40)]
    docs = [(i, line) for i, line in enumerate(lines)] + [(90, lines[0]), (91, lines[1][:-1] + "z")]
    got = linededup.clean(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["__gone"] for r in got.collect() if r["__gone"]} == {90: 1, 91: 1}
    assert [n for cols, n in stored.values() if {"line", "text"} & set(cols)] == [2]


def test_spectra_allow_for_all_within_two_edits(spark):
    rng, pairs = random.Random(7), []
    for _ in range(3000):
        a = [rng.choice("etaoinsrxyzé ") for _ in range(rng.choice([24, 30, 71, 72, 143, 144, 145, 146, 200]))]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 1)] = rng.choices("etaoinsr", k=rng.randint(0, 1))
        pairs.append(("".join(a), "".join(b)))
    both = [linededup.signed(spark.createDataFrame(
        [(i, p[k]) for i, p in enumerate(pairs)], "i int, line string")).select("i", F.expr(
            "try_element_at(filter(own, x -> x is not null), 1)").alias(f"x{k}")) for k in (0, 1)]
    met = both[0].join(both[1], "i").where("x0 is not null and x1 is not null")
    assert met.count() > 2500
    assert met.where(~linededup.alike(F.col("x0"), F.col("x1"), 2)).count() == 0


def test_near_is_the_edit_distance_in_characters(spark):
    rng, pairs = random.Random(5), []
    for _ in range(400):
        a = rng.choices("abé漢😀 ", k=rng.choice([24, 25, 60]))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 1)] = rng.choices("abé漢😀", k=rng.randint(0, 1))
        pairs.append(("".join(a), "".join(b)))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.near(F.col("a"), F.col("b")).alias("n"))
    assert [r["n"] for r in got.collect()] == [distance(a, b) <= 2 for a, b in pairs]


def test_pairs_under_a_crowded_signature_are_not_stored(spark, monkeypatch):
    """Near copies of one long line, each with a word changed in its middle, where no spectrum looks."""
    stored, write = {}, linededup.materialize

    def seen(df, label):
        out = write(df, label)
        stored[label] = out.count()
        return out

    monkeypatch.setattr(linededup, "materialize", seen)
    rng = random.Random(11)
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(300))
    lines = [base[:130] + hashlib.md5(b"%d" % i).hexdigest()[:20] + base[150:] for i in range(120)]
    lines += [lines[7][:149] + "xy" + lines[7][150:], "é" + lines[8][1:], lines[9][:-2]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc_id"]: r["__gone"] for r in linededup.clean(docs).collect() if r["__gone"]} == {120: 1, 121: 1, 122: 1}
    assert stored["crowded"] > 0 and stored["pairs"] < 5 * len(lines)
