"""Catalog listings and entitlements, set-based.

What a member sees depends only on the tenant, on being an administrator and on the groups the
member is in. Members alike in all three form an *access class*; visibility is worked out per
class, and `viewers` tells each member's class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulith.functions.text import name_collision_key

ADMIN_ROLES = ["owner", "admin"]


# ── access classes ────────────────────────────────────────────────────────────


def viewers(memberships: DataFrame, group_members: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, enterprise_id, access_class, is_admin, groups) per membership.

    Groups without any grant cannot matter and do not split classes.
    """
    granted = grants.select("group_id").distinct()
    groups = (
        group_members.join(granted, "group_id", "left_semi")
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_set("group_id")).alias("__groups"))
    )
    is_admin = F.col("role").isin(ADMIN_ROLES)
    no_groups = F.array().cast(grants.select(F.array("group_id")).schema[0].dataType)
    joined = memberships.join(groups, "user_id", "left").select(
        "user_id", "enterprise_id", is_admin.alias("is_admin"),
        F.when(is_admin, no_groups).otherwise(F.coalesce("__groups", no_groups)).alias("groups"),
    )
    label = F.concat(
        F.col("enterprise_id").cast("string"),
        F.when(F.col("is_admin"), F.lit(":admin")).otherwise(
            F.concat(F.lit(":"), F.array_join(F.col("groups").cast("array<string>"), ","))
        ),
    )
    return joined.withColumn("access_class", label)


def access_classes(members: DataFrame) -> DataFrame:
    return members.select("access_class", "enterprise_id", "is_admin", "groups").distinct()


def _folder_rules(folders: DataFrame, grants: DataFrame) -> DataFrame:
    """Folders with `access`: open (public, or protected without grants), groups, closed."""
    restricted = grants.select("folder_id").distinct().withColumn("__r", F.lit(True))
    access = (
        F.when(F.col("privacy") == "public", "open")
        .when(F.col("privacy") == "private", "closed")
        .when(F.col("__r"), "groups")
        .otherwise("open")
    )
    return folders.join(restricted, "folder_id", "left").withColumn("access", access).drop("__r")


def _granted_folders(classes: DataFrame, grants: DataFrame) -> DataFrame:
    plain = classes.where(~F.col("is_admin"))
    return (
        plain.select("access_class", "enterprise_id", F.explode("groups").alias("group_id"))
        .join(grants.select("folder_id", "group_id"), "group_id")
        .select("access_class", "enterprise_id", "folder_id")
        .distinct()
    )


def visible_folders(classes: DataFrame, folders: DataFrame, grants: DataFrame) -> DataFrame:
    """(access_class, folder_id): three equi-joins, each emitting only what is visible."""
    rules = _folder_rules(folders, grants).select("folder_id", "enterprise_id", "access")
    admin, plain = classes.where("is_admin"), classes.where("not is_admin")
    of_tenant = admin.join(rules, "enterprise_id")
    open_to_all = plain.join(rules.where("access = 'open'"), "enterprise_id")
    by_group = _granted_folders(classes, grants).join(
        rules.where("access = 'groups'"), ["folder_id", "enterprise_id"]
    )
    pick = ["access_class", "folder_id"]
    return of_tenant.select(*pick).unionAll(open_to_all.select(*pick)).unionAll(by_group.select(*pick))


def visible_datasets(
    classes: DataFrame, datasets: DataFrame, folders: DataFrame, grants: DataFrame
) -> DataFrame:
    """(access_class, dataset_id). A dataset in no folder is visible to its whole tenant."""
    rules = _folder_rules(folders, grants).select("folder_id", "access")
    placed = datasets.select("dataset_id", "enterprise_id", "folder_id").join(
        rules, "folder_id", "left"
    )
    admin, plain = classes.where("is_admin"), classes.where("not is_admin")
    of_tenant = admin.join(placed, "enterprise_id")
    open_to_all = plain.join(
        placed.where("folder_id is null or access = 'open'"), "enterprise_id"
    )
    by_group = _granted_folders(classes, grants).join(
        placed.where("access = 'groups'"), ["folder_id", "enterprise_id"]
    )
    pick = ["access_class", "dataset_id"]
    return of_tenant.select(*pick).unionAll(open_to_all.select(*pick)).unionAll(by_group.select(*pick))


def writable_datasets(classes: DataFrame, datasets: DataFrame, folders: DataFrame) -> DataFrame:
    """(access_class, dataset_id): administrators all, others those in public folders."""
    public = datasets.join(
        folders.where("privacy = 'public'").select("folder_id"), "folder_id", "left_semi"
    )
    pick = ["access_class", "dataset_id"]
    admin = classes.where("is_admin").join(datasets, "enterprise_id").select(*pick)
    return admin.unionAll(classes.where("not is_admin").join(public, "enterprise_id").select(*pick))


def list_tables(
    classes: DataFrame,
    datasets: DataFrame,
    folders: DataFrame,
    grants: DataFrame,
    include_pending: bool = False,
    limit: int = 50,
    name_contains: str = "",
    sort: str = "recent",
    direction: str | None = None,
    pinned: list[int] | None = None,
) -> DataFrame:
    """First tables of each access class. `sort` recent, alphabet or rows; pinned ones first."""
    listed = datasets if include_pending else datasets.where("is_index_ready")
    if name_contains.strip():
        listed = listed.where(F.lower("name").contains(name_contains.strip().lower()))
    named = listed.join(
        folders.select("folder_id", F.col("name").alias("folder_name"), "privacy"), "folder_id", "left"
    ).select(
        "dataset_id", "name", "row_count", "folder_id", "folder_name",
        F.coalesce("privacy", F.lit("protected")).alias("folder_privacy"),
    )
    shown = visible_datasets(classes, listed, folders, grants).join(named, "dataset_id")
    key = {"recent": F.col("dataset_id"), "alphabet": F.lower("name"), "rows": F.col("row_count")}[sort]
    ascending = (direction or ("asc" if sort == "alphabet" else "desc")) == "asc"
    order = [key.asc() if ascending else key.desc(), F.col("dataset_id").desc()]
    if pinned:
        order.insert(0, F.col("dataset_id").isin(pinned).desc())
    rank = F.row_number().over(Window.partitionBy("access_class").orderBy(*order))
    keep = max(1, limit)
    return shown.withColumn("position", rank).where(F.col("position") <= keep)


# ── folders and groups ────────────────────────────────────────────────────────


def folder_summary(
    classes: DataFrame, datasets: DataFrame, folders: DataFrame, grants: DataFrame
) -> DataFrame:
    """Visible folders per access class with their dataset counts."""
    counts = datasets.groupBy("folder_id").agg(F.count(F.lit(1)).alias("dataset_count"))
    described = folders.join(counts, "folder_id", "left").select(
        "folder_id", "name", "privacy", "sort_order",
        F.coalesce("dataset_count", F.lit(0)).alias("dataset_count"),
    )
    return visible_folders(classes, folders, grants).join(described, "folder_id")


def folder_datasets(
    classes: DataFrame, datasets: DataFrame, folders: DataFrame, grants: DataFrame
) -> DataFrame:
    """Datasets of each visible folder."""
    inside = datasets.select("folder_id", "dataset_id", "name", "row_count")
    return visible_folders(classes, folders, grants).join(inside, "folder_id")


def group_summary(groups: DataFrame, group_members: DataFrame, grants: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("group_id").agg(F.count(F.lit(1)).alias(name))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return (
        groups.join(count(group_members, "member_count"), "group_id", "left")
        .join(count(grants, "folder_access_count"), "group_id", "left")
        .select("group_id", "enterprise_id", "name", zero("member_count"), zero("folder_access_count"))
    )


def group_grants(groups: DataFrame, grants: DataFrame, folders: DataFrame) -> DataFrame:
    """Every grant with the names of its group and folder."""
    return grants.join(
        groups.select("group_id", F.col("name").alias("group_name")), "group_id"
    ).join(folders.select("folder_id", F.col("name").alias("folder_name"), "privacy"), "folder_id")


def group_members_list(groups: DataFrame, group_members: DataFrame, users: DataFrame) -> DataFrame:
    return group_members.join(groups.select("group_id", "name"), "group_id").join(
        users.select("user_id", "login"), "user_id"
    )


def reorder_folders(folders: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """New sort_order per tenant: listed folders take 0, 1, …; the rest follow as they stood.

    Without a list the order is by name.
    """
    if listed is None:
        order = [F.col("name"), F.col("folder_id")]
        placed = folders
    else:
        placed = folders.join(listed.select("folder_id", "place"), "folder_id", "left")
        order = [F.col("place").asc_nulls_last(), F.col("sort_order"), F.col("name"), F.col("folder_id")]
    rank = F.row_number().over(Window.partitionBy("enterprise_id").orderBy(*order)) - 1
    return placed.select("folder_id", "enterprise_id", "name", rank.alias("sort_order"))


# ── members ───────────────────────────────────────────────────────────────────


def workspace_list(memberships: DataFrame, enterprises: DataFrame, users: DataFrame) -> DataFrame:
    """Tenants of each user with role, size and which one is active."""
    sizes = memberships.groupBy("enterprise_id").agg(F.count(F.lit(1)).alias("member_count"))
    last = users.select("user_id", F.col("last_active_enterprise_id").alias("__last"))
    named = enterprises.join(sizes, "enterprise_id").select(
        "enterprise_id", F.col("name").alias("enterprise_name"), "member_count"
    )
    joined = memberships.join(last, "user_id").join(named, "enterprise_id")
    active = joined.groupBy("user_id").agg(
        F.coalesce(
            F.max(F.when(F.col("enterprise_id") == F.col("__last"), F.col("enterprise_id"))),
            F.min_by("enterprise_id", "membership_id"),
        ).alias("__active")
    )
    return joined.join(active, "user_id").select(
        "user_id", "enterprise_id", "enterprise_name", "role", "member_count",
        (F.col("enterprise_id") == F.col("__active")).alias("is_active"),
    )


def member_list(memberships: DataFrame, users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Members with login and whether they have a token in that tenant."""
    keys = tokens.select("user_id", "enterprise_id").distinct().withColumn("__t", F.lit(True))
    return (
        memberships.join(users.select("user_id", "login"), "user_id")
        .join(keys, ["user_id", "enterprise_id"], "left")
        .select("enterprise_id", "user_id", "login", "role",
                F.coalesce("__t", F.lit(False)).alias("has_token"))
    )


def promote_owner(memberships: DataFrame) -> DataFrame:
    """Tenants without an owner get their earliest administrator as one."""
    first = memberships.groupBy("enterprise_id").agg(
        F.bool_or(F.col("role") == "owner").alias("__owned"),
        F.min(F.when(F.col("role") == "admin", F.col("membership_id"))).alias("__first"),
    )
    promoted = ~F.col("__owned") & (F.col("membership_id") == F.col("__first"))
    return memberships.join(first, "enterprise_id").select(
        *[c for c in memberships.columns if c != "role"],
        F.when(promoted, "owner").otherwise(F.col("role")).alias("role"),
    )


def recode_roles(memberships: DataFrame, legacy: DataFrame) -> DataFrame:
    """member becomes querier; legacy (user_id, enterprise_id, role) rows join if absent."""
    recode = F.when(F.col("role") == "member", "querier").otherwise(
        F.coalesce("role", F.lit("querier"))
    )
    pick = ["user_id", "enterprise_id"]
    added = legacy.where("enterprise_id is not null").join(memberships, pick, "left_anti")
    return (
        memberships.select(*pick, "role").unionByName(added.select(*pick, "role"))
        .withColumn("role", recode)
    )


# ── datasets ──────────────────────────────────────────────────────────────────


def name_conflicts(datasets: DataFrame) -> DataFrame:
    """Datasets whose names collide within their tenant; no tenant is a scope of its own."""
    keyed = datasets.select("dataset_id", "enterprise_id", "name",
                            name_collision_key(F.col("name")).alias("collision_key"))
    shared = (
        keyed.groupBy("enterprise_id", "collision_key")
        .agg(F.count(F.lit(1)).alias("uses"))
        .where("uses > 1")
        .withColumnsRenamed({"enterprise_id": "__e", "collision_key": "__k"})
    )
    same = F.col("enterprise_id").eqNullSafe(F.col("__e")) & (F.col("collision_key") == F.col("__k"))
    return keyed.join(shared, same).drop("__e", "__k")


def orphan_datasets(datasets: DataFrame, folders: DataFrame) -> DataFrame:
    """Datasets in no folder, or in one that is gone."""
    return datasets.join(folders.select("folder_id"), "folder_id", "left_anti").select("dataset_id")


def cascade(dependents: DataFrame, removed: DataFrame) -> DataFrame:
    """What is left of rows, columns or vectors once their datasets are removed."""
    return dependents.join(removed.select("dataset_id"), "dataset_id", "left_anti")


# ── vector index ──────────────────────────────────────────────────────────────


def _index_counts(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("dataset_id").agg(F.count(F.lit(1)).alias(name))
    return count(rows, "total_rows").join(count(vectors, "__v"), "dataset_id", "left").withColumn(
        "processed_rows", F.least(F.coalesce("__v", F.lit(0)), F.col("total_rows"))
    ).drop("__v")


def index_status(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per dataset: ready or indexing, with progress in percent."""
    done: Column = F.col("processed_rows") >= F.col("total_rows")
    return _index_counts(rows, vectors).select(
        "dataset_id", "processed_rows", "total_rows",
        F.when(done, "ready").otherwise("indexing").alias("state"),
        (F.col("processed_rows") / F.col("total_rows") * 100.0).alias("progress"),
    )


def index_backlog(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows that still lack a vector."""
    return rows.join(vectors, ["dataset_id", "row_index"], "left_anti")
