"""Which dataset a request means.

Names are compared as lower-case word strings. Containment goes through an index of short pieces:
a text that contains a name contains every piece of it, so names and texts meet under the name's
rarest piece, an equi-join, and only what meets is compared. A piece has three characters, or as
many as the name if that is shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulith.functions.text import match_token, sanitize_name


def _file_stem(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"\.[^.]*$", "")


PIECE = 3


def _pieces(token: Column, size: Column | int) -> Column:
    """The distinct pieces of `size` characters."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(token) - size + 1
    return F.when(last > 0, F.array_distinct(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(token, i, size))))


def contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): which of the distinct `needles` stand in which of the distinct `texts`
    (their only columns); empty ones in none.

    A text has an entry per distinct piece, a needle is looked up under one piece: the one in the
    fewest texts. A needle with a piece that no text has is left out before the join.
    """
    needles = needles.toDF("needle").where("needle <> ''")
    texts = texts.toDF("text").where("text <> ''")
    # Texts are cut to pieces of a size only if a needle is that short: sizes are three at most.
    size = F.least(F.length("needle"), F.lit(PIECE))
    sizes = sorted(r[0] for r in needles.select(size.alias("s")).distinct().collect())
    if not sizes:
        return needles.select("needle", F.col("needle").alias("text")).limit(0)
    entries = texts.select("text", F.explode(F.concat(
        *[F.coalesce(_pieces(F.col("text"), n), F.array().cast("array<string>")) for n in sizes])).alias("piece"))
    asked = needles.select("needle", F.explode(_pieces(F.col("needle"), size)).alias("piece"))
    # Counted for pieces that are asked for only.
    known = entries.join(asked.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(
        F.count(F.lit(1)).alias("n"))
    rarest = asked.join(known, "piece", "left").groupBy("needle").agg(
        F.min(F.struct("n", "piece")).alias("least"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    keyed = rarest.where("all").select("needle", "least.piece")
    return entries.join(keyed, "piece").where(F.col("text").contains(F.col("needle"))).select("needle", "text")


def _named(datasets: DataFrame) -> DataFrame:
    return datasets.select(
        "dataset_id", "row_count",
        match_token(F.col("name")).alias("name_token"),
        match_token(_file_stem(F.col("source_filename"))).alias("file_token"),
    )


def _pairs(named: DataFrame) -> DataFrame:
    """Distinct (name, file) tokens with what is needed of the datasets that share them."""
    bonus = F.coalesce("row_count", F.lit(0)) * 0.01 + F.col("dataset_id") * 0.001
    return named.groupBy("name_token", "file_token").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.min("dataset_id").alias("first_id"),
        F.max(F.struct(bonus.alias("bonus"), F.col("dataset_id").alias("id"))).alias("best"),
    )


def _tokens(pairs: DataFrame) -> DataFrame:
    """The distinct tokens of names and files."""
    return pairs.select(F.explode(F.array("name_token", "file_token")).alias("token")).where(
        "token <> ''").distinct()


def _of_tokens(found: DataFrame, pairs: DataFrame, kept: str) -> DataFrame:
    """(kept, name_token, file_token) of the pairs that own a found `token`, each once."""
    name, file = (pairs.select("name_token", "file_token", F.col(c).alias("token")) for c in ("name_token", "file_token"))
    owners = name.unionByName(file.where("name_token <> file_token"))
    return found.join(owners, "token").select(kept, "name_token", "file_token").distinct()


def resolve_dataset_strict(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """(request_id, dataset_id?, dataset_name?) to `resolved_id` and `status`.

    ok, not_found, ambiguous (several), conflict (id and name disagree), name_required.
    """
    pairs = _pairs(_named(datasets))
    cleaned = F.coalesce(F.nullif(sanitize_name(F.col("dataset_name")), F.lit("")), F.col("dataset_name"))
    asked = requests.select(
        "request_id", F.col("dataset_id").alias("asked_id"),
        (F.trim(F.coalesce("dataset_name", F.lit(""))) != "").alias("has_name"),
        match_token(cleaned).alias("needle"),
    )
    needles = asked.where("needle <> ''").select("needle").distinct()
    inside = contained(needles, _tokens(pairs)).withColumnRenamed("text", "token")
    found = (
        _of_tokens(inside, pairs, "needle").join(pairs, ["name_token", "file_token"])
        .withColumn("exact", F.col("needle").isin(F.col("name_token"), F.col("file_token")))
        .groupBy("needle", "exact")
        .agg(F.sum("datasets").alias("n"), F.min("first_id").alias("id"))
    )
    # Exact matches, if there are any, are the only candidates.
    match = found.groupBy("needle").agg(
        F.max_by(F.struct("n", "id"), F.col("exact").cast("int")).alias("m")
    ).select("needle", "m.*")
    ids = datasets.select(F.col("dataset_id").alias("asked_id"), F.lit(True).alias("known"))
    total = datasets.agg(F.count(F.lit(1)).alias("n")).scalar()
    only = datasets.agg(F.min("dataset_id").alias("id")).scalar()
    joined = asked.join(match, "needle", "left").join(ids, "asked_id", "left")
    by_id = ~F.col("has_name") & F.col("asked_id").isNotNull()
    status = (
        F.when(by_id, F.when(F.col("known"), "ok").otherwise("not_found"))
        .when(F.col("has_name"),
              F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous")
              .when(F.col("asked_id") != F.col("id"), "conflict").otherwise("ok"))
        .when(total == 0, "not_found")
        .when(total == 1, "ok")
        .otherwise("name_required")
    )
    resolved = F.when(by_id, F.col("asked_id")).when(F.col("has_name"), F.col("id")).otherwise(only)
    return joined.select("request_id", F.when(status == "ok", resolved).alias("resolved_id"),
                         status.alias("status"))


def resolve_dataset(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """(request_id, dataset_id?, dataset_name?, question) to the best-scoring dataset.

    Points: 300 name equal, 280 file equal, 210 / 190 contained in name / file, 120 / 100 name /
    file said in the question, then a little for rows and for being recent. `status` is ok,
    not_found or hint_required.
    """
    pairs = _pairs(_named(datasets))
    asked = requests.select(
        "request_id", F.col("dataset_id").alias("asked_id"),
        match_token(F.col("dataset_name")).alias("wanted"),
        match_token(F.col("question")).alias("said"),
    )
    tokens = _tokens(pairs)
    wanted = asked.where("wanted <> ''").select("wanted").distinct()
    by_name = (
        _of_tokens(contained(wanted, tokens).select(F.col("needle").alias("wanted"), F.col("text").alias("token")), pairs, "wanted")
        .join(asked.select("request_id", "wanted"), "wanted")
        .select("request_id", "name_token", "file_token")
    )
    heard = contained(tokens, asked.select("said").distinct()).select(
        F.col("needle").alias("token"), F.col("text").alias("said"))
    in_question = (
        _of_tokens(heard, pairs, "said")
        .join(asked.select("request_id", "said"), "said")
        .select("request_id", "name_token", "file_token", F.lit(True).alias("heard"))
    )
    # The best dataset without any match competes too: size alone may beat a match.
    everything = pairs.agg(F.max("best").alias("b")).scalar()
    candidates = (
        by_name.withColumn("heard", F.lit(False)).unionByName(in_question)
        .groupBy("request_id", "name_token", "file_token").agg(F.bool_or("heard").alias("heard"))
        .join(pairs.select("name_token", "file_token", "best"), ["name_token", "file_token"])
        .join(asked, "request_id")
    )
    name, file, wanted, said_ = (F.col(c) for c in ("name_token", "file_token", "wanted", "said"))
    points = (
        F.when(wanted == "", 0.0).when(wanted == name, 300.0).when(wanted == file, 280.0)
        .when(name.contains(wanted), 210.0).when(file.contains(wanted), 190.0).otherwise(0.0)
        + F.when((name != "") & said_.contains(name), 120.0).otherwise(0.0)
        + F.when((file != "") & said_.contains(file), 100.0).otherwise(0.0)
    )
    top = candidates.groupBy("request_id").agg(
        F.max(F.struct((points + F.col("best.bonus")).alias("score"), F.col("best.id").alias("id"))).alias("top"),
        F.bool_or("heard").alias("heard"),
    )
    ids = datasets.select(F.col("dataset_id").alias("asked_id"), F.lit(True).alias("known"))
    total = datasets.agg(F.count(F.lit(1)).alias("n")).scalar()
    fallback = F.struct(everything["bonus"].alias("score"), everything["id"].alias("id"))
    joined = asked.join(top, "request_id", "left").join(ids, "asked_id", "left").withColumn(
        "pick", F.greatest(F.coalesce("top", fallback), fallback)
    )
    hinted = (F.col("wanted") != "") | F.coalesce("heard", F.lit(False))
    status = (
        F.when(F.col("known"), "ok")
        .when(total == 0, "not_found")
        .when(F.col("asked_id").isNull() & (total > 1) & ~hinted, "hint_required")
        .when(F.col("asked_id").isNotNull() & ~hinted & (F.col("pick.score") < 50.0), "not_found")
        .otherwise("ok")
    )
    resolved = F.when(F.col("known"), F.col("asked_id")).otherwise(F.col("pick.id"))
    return joined.select("request_id", F.when(status == "ok", resolved).alias("resolved_id"),
                         status.alias("status"))

