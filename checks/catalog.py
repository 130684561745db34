"""Catalog and entitlement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import base, fixture, with_
from tabulith.operators import catalog, headers, resolve

ACL = ["fx_folders", "fx_memberships", "fx_group_members", "fx_grants", "fx_datasets"]


def acl(s, sf):
    folders, members, group_members, grants, datasets = (fixture(s, sf, n) for n in ACL)
    viewers = catalog.viewers(members, group_members, grants)
    return viewers, catalog.access_classes(viewers), datasets, folders, grants


def visible(s, sf):
    viewers, classes, datasets, folders, grants = acl(s, sf)
    return catalog.visible_datasets(classes, datasets, folders, grants)


def viewer_classes(s, sf):
    return acl(s, sf)[0].select("user_id", "enterprise_id", "access_class")


def tables(s, sf):
    _, classes, datasets, folders, grants = acl(s, sf)
    return catalog.list_tables(classes, datasets, folders, grants, limit=30).select(
        "access_class", F.col("position").cast("bigint").alias("position"), "dataset_id", "name", "folder_name", "folder_privacy")


def tables_by_name(s, sf):
    _, classes, datasets, folders, grants = acl(s, sf)
    return catalog.list_tables(classes, datasets, folders, grants, True, 20, "RING", "alphabet", pinned=[7, 26]).select(
        "access_class", F.col("position").cast("bigint").alias("position"), "dataset_id")


def four(op):
    def run(s, sf):
        _, classes, datasets, folders, grants = acl(s, sf)
        return op(classes, datasets, folders, grants)
    return run


def requests(s, sf):
    """A request per part, naming a dataset in one of several ways."""
    k = F.col("p_partkey") % 9
    first = F.split("p_name", " ")[0]
    return base(s, sf, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.when(k.isin(0, 5), F.col("p_partkey")).when(k == 1, F.lit(-1)).cast("bigint").alias("dataset_id"),
        F.when(k.isin(2, 5), F.upper("p_name")).when(k == 3, F.concat(first, F.lit(" "))).when(k == 4, F.lit("nothing like it"))
        .when(k == 8, F.concat(F.col("p_name"), F.lit(".csv"))).alias("dataset_name"),
        F.when(k == 6, F.concat(F.lit("How many rows does "), F.col("p_name"), F.lit(" have?"))).otherwise("How many rows?").alias("question"))


def datasets(s, sf):
    return fixture(s, sf, "fx_datasets").where("is_index_ready")


QUERIES = {
    "visible_datasets": visible,
    "viewer_classes": viewer_classes,
    "list_tables": tables,
    "list_tables_sorted": tables_by_name,
    "writable_datasets": lambda s, sf: catalog.writable_datasets(*acl(s, sf)[1:4]),
    "folder_summary": four(catalog.folder_summary),
    "folder_datasets": four(catalog.folder_datasets),
    "group_summary": lambda s, sf: catalog.group_summary(
        fixture(s, sf, "fx_groups"), fixture(s, sf, "fx_group_members"), fixture(s, sf, "fx_grants")),
    "group_grants": lambda s, sf: catalog.group_grants(
        fixture(s, sf, "fx_groups"), fixture(s, sf, "fx_grants"), fixture(s, sf, "fx_folders")),
    "group_members": lambda s, sf: catalog.group_members_list(
        fixture(s, sf, "fx_groups"), fixture(s, sf, "fx_group_members"), fixture(s, sf, "fx_users")),
    "workspace_list": lambda s, sf: catalog.workspace_list(
        fixture(s, sf, "fx_memberships"),
        base(s, sf, "region").select(F.col("r_regionkey").alias("enterprise_id"), F.col("r_name").alias("name")),
        fixture(s, sf, "fx_users")),
    "member_list": lambda s, sf: catalog.member_list(
        fixture(s, sf, "fx_memberships"), fixture(s, sf, "fx_users"), fixture(s, sf, "fx_memberships").where("has_token")),
    "name_conflicts": lambda s, sf: catalog.name_conflicts(fixture(s, sf, "fx_datasets")),
    "claim_unique_names": lambda s, sf: headers.claim_unique_names(
        fixture(s, sf, "fx_datasets"), "enterprise_id", "dataset_id", "name"),
    "claim_folder_names": lambda s, sf: headers.claim_folder_names(
        fixture(s, sf, "fx_datasets").withColumn("name", F.repeat(F.upper("name"), F.lit(40))), "enterprise_id", "dataset_id", "name"),
    "reorder_folders": lambda s, sf: catalog.reorder_folders(
        fixture(s, sf, "fx_folders"),
        fixture(s, sf, "fx_folders").where("privacy = 'private'").select("folder_id", (-F.col("folder_id")).alias("place"))
    ).withColumn("sort_order", F.col("sort_order").cast("bigint")),
    "backfill_folder_order": lambda s, sf: catalog.reorder_folders(fixture(s, sf, "fx_folders")).withColumn(
        "sort_order", F.col("sort_order").cast("bigint")),
    "promote_owner": lambda s, sf: catalog.promote_owner(fixture(s, sf, "fx_memberships")),
    "recode_roles": lambda s, sf: catalog.recode_roles(
        fixture(s, sf, "fx_memberships"),
        fixture(s, sf, "fx_users").select("user_id", F.col("last_active_enterprise_id").alias("enterprise_id"), F.lit("member").alias("role"))),
    "orphan_cascade": lambda s, sf: catalog.cascade(
        fixture(s, sf, "fx_columns"), catalog.orphan_datasets(
            fixture(s, sf, "fx_datasets"), fixture(s, sf, "fx_folders").where("privacy <> 'private'"))),
    "index_status": lambda s, sf: catalog.index_status(
        fixture(s, sf, "fx_vector_rows"), fixture(s, sf, "fx_vectors")).withColumn("progress", F.round("progress", 4)),
    "index_backlog": lambda s, sf: catalog.index_backlog(fixture(s, sf, "fx_vector_rows"), fixture(s, sf, "fx_vectors")),
    "resolve_dataset": lambda s, sf: resolve.resolve_dataset(requests(s, sf), datasets(s, sf)),
    "resolve_dataset_strict": lambda s, sf: resolve.resolve_dataset_strict(requests(s, sf), datasets(s, sf)),
}

_V = dict(
    ug="""SELECT user_id, list_sort(list_distinct(list(group_id))) AS g FROM fx_group_members
  WHERE group_id IN (SELECT group_id FROM fx_grants) GROUP BY 1""",
    vw="""SELECT m.user_id, m.enterprise_id, role IN ('owner','admin') AS is_admin,
  CASE WHEN role IN ('owner','admin') THEN [] ELSE coalesce(g, []) END AS groups,
  CAST(m.enterprise_id AS VARCHAR) || CASE WHEN role IN ('owner','admin') THEN ':admin' ELSE ':' || coalesce(array_to_string(g, ','), '') END AS access_class
  FROM fx_memberships m LEFT JOIN ug ON ug.user_id = m.user_id""",
    cl="SELECT DISTINCT access_class, enterprise_id, is_admin, groups FROM vw",
    fv="""SELECT cl.access_class, f.* FROM cl JOIN fx_folders f ON f.enterprise_id = cl.enterprise_id
  WHERE is_admin OR privacy = 'public' OR (privacy = 'protected' AND (
   NOT EXISTS (SELECT 1 FROM fx_grants r WHERE r.folder_id = f.folder_id)
   OR EXISTS (SELECT 1 FROM fx_grants r WHERE r.folder_id = f.folder_id AND list_contains(cl.groups, r.group_id))))""",
    dv="""SELECT cl.access_class, d.* FROM cl JOIN fx_datasets d ON d.enterprise_id = cl.enterprise_id
  WHERE is_admin OR d.folder_id IS NULL OR EXISTS (SELECT 1 FROM fv WHERE fv.access_class = cl.access_class AND fv.folder_id = d.folder_id)""",
)
VIEW = with_(*ACL, **_V)
_TOKEN = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
_REQ = """SELECT p_partkey AS request_id, CASE WHEN p_partkey % 9 IN (0, 5) THEN p_partkey WHEN p_partkey % 9 = 1 THEN -1 END AS asked_id,
 CASE WHEN p_partkey % 9 IN (2, 5) THEN upper(p_name) WHEN p_partkey % 9 = 3 THEN split_part(p_name, ' ', 1) || ' ' WHEN p_partkey % 9 = 4 THEN 'nothing like it'
 WHEN p_partkey % 9 = 8 THEN p_name || '.csv' END AS dataset_name,
 CASE WHEN p_partkey % 9 = 6 THEN 'How many rows does ' || p_name || ' have?' ELSE 'How many rows?' END AS question FROM part"""
_DS = f"""SELECT dataset_id, row_count, {_TOKEN('name')} AS nt, {_TOKEN("regexp_replace(source_filename, '[.][^.]*$', '')")} AS ft, name
 FROM fx_datasets WHERE is_index_ready"""

ORACLES = {
    "visible_datasets": VIEW + "SELECT access_class, dataset_id FROM dv",
    "viewer_classes": VIEW + "SELECT user_id, enterprise_id, access_class FROM vw",
    "list_tables": VIEW + """, r AS (SELECT dv.*, f.name AS folder_name, coalesce(f.privacy, 'protected') AS folder_privacy,
  row_number() OVER (PARTITION BY access_class ORDER BY dataset_id DESC) AS position FROM dv LEFT JOIN fx_folders f ON f.folder_id = dv.folder_id WHERE is_index_ready)
SELECT access_class, position, dataset_id, name, folder_name, folder_privacy FROM r WHERE position <= 30""",
    "list_tables_sorted": VIEW + """, r AS (SELECT access_class, dataset_id, row_number() OVER (PARTITION BY access_class
  ORDER BY dataset_id IN (7, 26) DESC, lower(name), dataset_id DESC) AS position FROM dv WHERE lower(name) LIKE '%ring%')
SELECT access_class, position, dataset_id FROM r WHERE position <= 20""",
    "writable_datasets": VIEW + """SELECT access_class, dataset_id FROM cl JOIN fx_datasets d ON d.enterprise_id = cl.enterprise_id
 LEFT JOIN fx_folders f ON f.folder_id = d.folder_id WHERE is_admin OR f.privacy = 'public'""",
    "folder_summary": VIEW + """SELECT fv.folder_id, fv.access_class, fv.name, fv.privacy, fv.sort_order,
 (SELECT count(*) FROM fx_datasets d WHERE d.folder_id = fv.folder_id) AS dataset_count FROM fv""",
    "folder_datasets": VIEW + "SELECT fv.folder_id, fv.access_class, d.dataset_id, d.name, d.row_count FROM fv JOIN fx_datasets d ON d.folder_id = fv.folder_id",
    "group_summary": with_("fx_groups", "fx_group_members", "fx_grants") + """SELECT group_id, enterprise_id, name,
 (SELECT count(*) FROM fx_group_members m WHERE m.group_id = g.group_id) AS member_count,
 (SELECT count(*) FROM fx_grants m WHERE m.group_id = g.group_id) AS folder_access_count FROM fx_groups g""",
    "group_grants": with_("fx_groups", "fx_grants", "fx_folders") + """SELECT r.folder_id, r.group_id, g.name AS group_name, f.name AS folder_name, f.privacy
 FROM fx_grants r JOIN fx_groups g ON g.group_id = r.group_id JOIN fx_folders f ON f.folder_id = r.folder_id""",
    "group_members": with_("fx_groups", "fx_group_members", "fx_users") + """SELECT m.user_id, m.group_id, g.name, u.login
 FROM fx_group_members m JOIN fx_groups g ON g.group_id = m.group_id JOIN fx_users u ON u.user_id = m.user_id""",
    "workspace_list": with_("fx_memberships", "fx_users") + """SELECT m.user_id, m.enterprise_id, r_name AS enterprise_name, m.role,
 (SELECT count(*) FROM fx_memberships x WHERE x.enterprise_id = m.enterprise_id) AS member_count,
 m.enterprise_id = coalesce((SELECT max(x.enterprise_id) FROM fx_memberships x WHERE x.user_id = m.user_id AND x.enterprise_id = u.last_active_enterprise_id),
  (SELECT arg_min(x.enterprise_id, x.membership_id) FROM fx_memberships x WHERE x.user_id = m.user_id)) AS is_active
 FROM fx_memberships m JOIN fx_users u ON u.user_id = m.user_id JOIN region ON r_regionkey = m.enterprise_id""",
    "member_list": with_("fx_memberships", "fx_users") + "SELECT m.enterprise_id, m.user_id, u.login, m.role, m.has_token FROM fx_memberships m JOIN fx_users u ON u.user_id = m.user_id",
    "name_conflicts": with_("fx_datasets") + """SELECT dataset_id, enterprise_id, name, lower(name) AS collision_key, uses FROM
 (SELECT *, count(*) OVER (PARTITION BY enterprise_id, lower(name)) AS uses FROM fx_datasets) WHERE uses > 1""",
    "claim_folder_names": with_("fx_datasets") + """SELECT dataset_id, enterprise_id, CASE WHEN k = 1 THEN n ELSE left(n, 254 - length(k::VARCHAR)) || '_' || k END AS unique_name FROM
 (SELECT *, row_number() OVER (PARTITION BY enterprise_id, lower(n) ORDER BY dataset_id) AS k FROM
  (SELECT *, left(trim(repeat(upper(name), 40)), 255) AS n FROM fx_datasets))""",
    "claim_unique_names": with_("fx_datasets") + """SELECT dataset_id, enterprise_id, CASE WHEN k = 1 THEN name ELSE name || '_' || k END AS unique_name FROM
 (SELECT *, row_number() OVER (PARTITION BY enterprise_id, lower(name) ORDER BY dataset_id) AS k FROM fx_datasets)""",
    "reorder_folders": with_("fx_folders") + """SELECT folder_id, enterprise_id, name, row_number() OVER (PARTITION BY enterprise_id
 ORDER BY CASE WHEN privacy = 'private' THEN -folder_id END NULLS LAST, sort_order, name, folder_id) - 1 AS sort_order FROM fx_folders""",
    "backfill_folder_order": with_("fx_folders") + """SELECT folder_id, enterprise_id, name, row_number() OVER (PARTITION BY enterprise_id
 ORDER BY name, folder_id) - 1 AS sort_order FROM fx_folders""",
    "promote_owner": with_("fx_memberships") + """SELECT membership_id, user_id, enterprise_id, has_token, CASE WHEN membership_id = (SELECT min(x.membership_id) FROM fx_memberships x
  WHERE x.enterprise_id = m.enterprise_id AND x.role = 'admin') AND NOT EXISTS (SELECT 1 FROM fx_memberships x WHERE x.enterprise_id = m.enterprise_id AND x.role = 'owner')
 THEN 'owner' ELSE role END AS role FROM fx_memberships m""",
    "recode_roles": with_("fx_memberships", "fx_users") + """SELECT user_id, enterprise_id, CASE WHEN role = 'member' THEN 'querier' ELSE role END AS role FROM fx_memberships
UNION ALL SELECT user_id, last_active_enterprise_id, 'querier' FROM fx_users u WHERE last_active_enterprise_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM fx_memberships m WHERE m.user_id = u.user_id AND m.enterprise_id = u.last_active_enterprise_id)""",
    "orphan_cascade": with_("fx_columns", "fx_datasets", "fx_folders") + """SELECT * FROM fx_columns c WHERE NOT EXISTS (SELECT 1 FROM fx_datasets d
 LEFT JOIN fx_folders f ON f.folder_id = d.folder_id AND f.privacy <> 'private' WHERE d.dataset_id = c.dataset_id AND f.folder_id IS NULL)""",
    "index_status": with_("fx_vectors", "fx_vector_rows") + """SELECT dataset_id, v AS processed_rows, t AS total_rows, CASE WHEN v >= t THEN 'ready' ELSE 'indexing' END AS state,
 round(v / t::DOUBLE * 100, 4) AS progress FROM (SELECT dataset_id, count(*) AS t, (SELECT count(*) FROM fx_vectors x WHERE x.dataset_id = r.dataset_id) AS v FROM fx_vector_rows r GROUP BY 1)""",
    "index_backlog": with_("fx_vectors", "fx_vector_rows") + "SELECT * FROM fx_vector_rows EXCEPT SELECT dataset_id, row_index FROM fx_vectors",
    "resolve_dataset": with_("fx_datasets", rq=_REQ, ds=_DS, t=f"SELECT *, {_TOKEN('dataset_name')} AS w, {_TOKEN('question')} AS q FROM rq", pr="""
  SELECT request_id, dataset_id, CASE WHEN w = '' THEN 0 WHEN w = nt THEN 300 WHEN w = ft THEN 280 WHEN contains(nt, w) THEN 210 WHEN contains(ft, w) THEN 190 ELSE 0 END
  + CASE WHEN nt <> '' AND contains(q, nt) THEN 120 ELSE 0 END + CASE WHEN ft <> '' AND contains(q, ft) THEN 100 ELSE 0 END + row_count*0.01::DOUBLE + dataset_id*0.001::DOUBLE AS score,
  (nt <> '' AND contains(q, nt)) OR (ft <> '' AND contains(q, ft)) AS heard FROM t CROSS JOIN ds""",
        b="SELECT request_id, arg_max(dataset_id, score) AS id, max(score) AS score, bool_or(heard) AS heard FROM pr GROUP BY 1") + """
SELECT t.request_id, CASE WHEN EXISTS (SELECT 1 FROM ds WHERE ds.dataset_id = t.asked_id) THEN asked_id WHEN asked_id IS NULL AND NOT (w <> '' OR heard) THEN NULL
  WHEN asked_id IS NOT NULL AND NOT (w <> '' OR heard) AND score < 50 THEN NULL ELSE id END AS resolved_id,
 CASE WHEN EXISTS (SELECT 1 FROM ds WHERE ds.dataset_id = t.asked_id) THEN 'ok' WHEN asked_id IS NULL AND NOT (w <> '' OR heard) THEN 'hint_required'
  WHEN asked_id IS NOT NULL AND NOT (w <> '' OR heard) AND score < 50 THEN 'not_found' ELSE 'ok' END AS status FROM t JOIN b ON b.request_id = t.request_id""",
    "resolve_dataset_strict": with_("fx_datasets", rq=_REQ, al=_DS, ds="SELECT * FROM al",
        t=f"SELECT *, {_TOKEN('regexp_replace(trim(dataset_name), chr(92) || chr(46) || chr(99) || chr(115) || chr(118) || chr(36), chr(32))')} AS w FROM rq",
        c="""SELECT *, (SELECT count(*) FROM ds WHERE w <> '' AND (nt = w OR ft = w)) AS ne, (SELECT min(dataset_id) FROM ds WHERE nt = w OR ft = w) AS ie,
  (SELECT count(*) FROM ds WHERE w <> '' AND (contains(nt, w) OR contains(ft, w))) AS np, (SELECT min(dataset_id) FROM ds WHERE contains(nt, w) OR contains(ft, w)) AS ip FROM t""",
        e="SELECT *, CASE WHEN ne > 0 THEN ne ELSE np END AS n, CASE WHEN ne > 0 THEN ie ELSE ip END AS id FROM c",
        st="""SELECT *, CASE WHEN dataset_name IS NULL AND asked_id IS NOT NULL THEN CASE WHEN EXISTS (SELECT 1 FROM ds WHERE ds.dataset_id = asked_id) THEN 'ok' ELSE 'not_found' END
  WHEN dataset_name IS NOT NULL THEN CASE WHEN n = 0 THEN 'not_found' WHEN n > 1 THEN 'ambiguous' WHEN asked_id <> id THEN 'conflict' ELSE 'ok' END ELSE 'name_required' END AS status FROM e""") + """
SELECT request_id, CASE WHEN status = 'ok' THEN CASE WHEN dataset_name IS NULL THEN asked_id ELSE id END END AS resolved_id, status FROM st""",
}
