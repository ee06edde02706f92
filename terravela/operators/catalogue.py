"""The tenant-scoped catalogue: what a viewer may see, counts, lists for administrators, changes as rewrites.

Every read goes through visible_sites. Tables are DataFrames: clients, users, sites, surveys, assets, videos,
grants(user_id, site_id) and changes; a change returns the table's new content and leaves writing it to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravela.functions.text import valid_uuid
from terravela.plans.lineage import broadcast_below

#: What a catalogue accepts.
CATEGORIES = ("report", "drawing", "photo", "lidar", "uav_dgps", "control_area")
MIME_TYPES = ("application/pdf", "image/webp", "image/png", "image/jpeg", "text/csv", "text/tab-separated-values")
STATUSES = ("planned", "active", "completed")
#: Rows of sites that may be broadcast, well below 100 MB of keys.
SITE_ROWS = 1_000_000


@dataclass(frozen=True)
class Viewer:
    user_id: str | int
    role: str = "client"
    client_id: str | int | None = None

    @property
    def is_owner(self) -> bool:
        return self.role != "client"


def visible_sites(sites: DataFrame, grants: DataFrame, viewer: Viewer) -> DataFrame:
    """Sites that a viewer may see: all for an owner, else the client's published ones, narrowed to grants if the user has any."""
    if viewer.is_owner:
        return sites
    own = sites.where((F.col("client_id") == F.lit(viewer.client_id)) & F.col("is_published"))
    granted = grants.where(F.col("user_id") == F.lit(viewer.user_id)).select(F.col("site_id").alias("id")).distinct()
    narrowed = granted.limit(1).select(F.lit(True).alias("_narrowed"))
    marked = own.join(granted.withColumn("_granted", F.lit(True)), "id", "left").join(F.broadcast(narrowed), F.lit(True), "left")
    return marked.where(F.col("_narrowed").isNull() | F.col("_granted")).select(*sites.columns)


def visible_by_client(sites: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, site_id) for every client's user at once, as equi-joins. An owner sees all sites and has no rows."""
    active = users.where("is_active")
    narrowed = grants.select("user_id").distinct().withColumn("narrowed", F.lit(True))
    mine = active.where(F.col("role") == "client").select(F.col("id").alias("user_id"), "client_id").join(narrowed, "user_id", "left")
    published = sites.where("is_published").select(F.col("id").alias("site_id"), "client_id")
    free = mine.where("narrowed IS NULL").join(published, "client_id").select("user_id", "site_id")
    granted = mine.where("narrowed").join(grants.select("user_id", "site_id").distinct(), "user_id").join(published, ["site_id", "client_id"]).select("user_id", "site_id")
    return free.unionByName(granted)


def visible_by_user(sites: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, site_id) for every user at once: the set form of visible_sites, with a row for each site of each owner.

    Owners are few by the nature of the role; where only counts are wanted, visible_totals needs no such rows.
    """
    owners = users.where(F.col("is_active") & (F.col("role") != "client")).select(F.col("id").alias("user_id"))
    return visible_by_client(sites, grants, users).unionByName(owners.join(sites.select(F.col("id").alias("site_id")), F.lit(True)))


def visible_totals(sites: DataFrame, grants: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, n_sites, ids): how many sites each user sees and the sum of their ids, without the rows of visible_by_user.

    Users without grants have their client's totals, owners the table's; only grants are counted one by one.
    """
    totals = [F.count(F.lit(1)).alias("n_sites"), F.sum("site_id").alias("ids")]
    active = users.where("is_active").withColumnRenamed("id", "user_id")
    mine = active.where(F.col("role") == "client").select("user_id", "client_id")
    published = sites.where("is_published").select(F.col("id").alias("site_id"), "client_id")
    free = mine.join(grants.select("user_id").distinct(), "user_id", "left_anti").join(published.groupBy("client_id").agg(*totals), "client_id")
    held = grants.select("user_id", "site_id").distinct().join(broadcast_below(published, SITE_ROWS), "site_id").groupBy("user_id", "client_id").agg(*totals)
    all_ = sites.select(F.col("id").alias("site_id")).agg(*totals).where("n_sites > 0")
    owners = active.where(F.col("role") != "client").crossJoin(F.broadcast(all_))  # one row
    parts = [df.select("user_id", "n_sites", "ids") for df in (free, mine.join(held, ["user_id", "client_id"]), owners)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("user_id").agg(F.sum("n_sites").alias("n_sites"), F.sum("ids").alias("ids"))


def visible_site(sites: DataFrame, grants: DataFrame, viewer: Viewer, slug: str) -> DataFrame:
    """The one site with a slug that a viewer may see, or no row; slugs are unique within a client only, the smallest id counts."""
    return visible_sites(sites, grants, viewer).where(F.col("slug") == slug).orderBy("id").limit(1)


def visible_assets(assets: DataFrame, sites: DataFrame, grants: DataFrame, viewer: Viewer, site_id=None, category: str | None = None) -> DataFrame:
    """Assets of visible sites, published ones only unless for an owner; a category narrows them. Order by (sort_order, title)."""
    seen = visible_sites(sites, grants, viewer).select(F.col("id").alias("site_id"))
    out = assets if viewer.is_owner else assets.where("is_published")
    if site_id is not None:
        out = out.where(F.col("site_id") == F.lit(site_id))
    if category is not None:
        out = out.where(F.col("category") == category)
    return out.join(broadcast_below(seen, SITE_ROWS), "site_id", "left_semi")


def visible_videos(videos: DataFrame, sites: DataFrame, grants: DataFrame, viewer: Viewer) -> DataFrame:
    return videos.join(broadcast_below(visible_sites(sites, grants, viewer).select(F.col("id").alias("site_id")), SITE_ROWS), "site_id", "left_semi")


def visible_asset(assets: DataFrame, sites: DataFrame, grants: DataFrame, viewer: Viewer, asset_id) -> DataFrame:
    """The one asset with an id that a viewer may see, or no row."""
    return visible_assets(assets.where(F.col("id") == F.lit(asset_id)), sites, grants, viewer).limit(1)


def queryable(seen: DataFrame, viewer: Viewer) -> DataFrame:
    """What a viewer sees, or nothing for a viewer whose id is no UUID: a malformed identity fails closed."""
    return seen.where(valid_uuid(F.lit(str(viewer.user_id))))


def ordered_sites(sites: DataFrame) -> DataFrame:
    return sites.orderBy("name", "id")


def ordered_assets(assets: DataFrame) -> DataFrame:
    return assets.orderBy("sort_order", "title", "id")


def ordered_surveys(surveys: DataFrame) -> DataFrame:
    """Latest flight first, those without a date last."""
    return surveys.orderBy(F.desc_nulls_last("flown_on"), "id")


def page(ordered: DataFrame, number: int, size: int = 100) -> DataFrame:
    """Page `number`, from 0, of an ordered frame."""
    return ordered.offset(number * size).limit(size)


def of_industry(sites: DataFrame, industry: str) -> DataFrame:
    """Sites of an industry; "All" is no filter."""
    return sites if industry == "All" else sites.where(F.col("industry") == industry)


def with_defaults(rows: DataFrame, texts: tuple[str, ...] = ("location", "summary")) -> DataFrame:
    """Rows as pages show them: a null among `texts` is an empty text, other nulls stay absent."""
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts if c in rows.columns})


def audit(changes: DataFrame, actor, action: str, subject: Column, details: Column, at: Column) -> DataFrame:
    """A row of the change log (actor_id, action, subject, detail JSON, created_at) for each changed row."""
    return changes.select(F.lit(actor).alias("actor_id"), F.lit(action).alias("action"), subject.cast("string").alias("subject"), F.to_json(details).alias("detail"), at.alias("created_at"))


def asset_counts(assets: DataFrame, sites: DataFrame, viewer: Viewer, site_id=None) -> DataFrame:
    """(category, n): a site's assets by category under the client and published rules. Grants don't narrow the counts."""
    seen = sites if viewer.is_owner else sites.where((F.col("client_id") == F.lit(viewer.client_id)) & F.col("is_published"))
    held = assets if viewer.is_owner else assets.where("is_published")
    if site_id is not None:
        held = held.where(F.col("site_id") == F.lit(site_id))
    return held.join(broadcast_below(seen.select(F.col("id").alias("site_id")), SITE_ROWS), "site_id", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def admin_clients(clients: DataFrame, sites: DataFrame, users: DataFrame) -> DataFrame:
    """Clients with the number of their sites and users, 0 for none."""
    n = lambda df, name: df.where("client_id IS NOT NULL").groupBy(F.col("client_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    return clients.join(n(sites, "site_count"), "id", "left").join(n(users, "user_count"), "id", "left").fillna(0, ["site_count", "user_count"])


def admin_users(users: DataFrame, clients: DataFrame, grants: DataFrame) -> DataFrame:
    """Users with their client's name and the sorted array of sites granted to them, empty for none."""
    held = grants.groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_set("site_id")).alias("granted"))
    named = clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name"))
    out = users.join(named, "client_id", "left").join(held, "id", "left")
    return out.withColumn("granted", F.coalesce("granted", F.array().cast(held.schema["granted"].dataType)))


def admin_sites(sites: DataFrame, clients: DataFrame, assets: DataFrame) -> DataFrame:
    """Sites with their client's name and the number of their assets."""
    n = assets.groupBy(F.col("site_id").alias("id")).agg(F.count(F.lit(1)).alias("asset_count"))
    return sites.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id").join(n, "id", "left").fillna(0, ["asset_count"])


def recent_changes(changes: DataFrame, users: DataFrame, limit: int = 15) -> DataFrame:
    """The latest changes with their actors' emails, by time and then id, both descending."""
    latest = changes.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)
    return latest.join(users.select(F.col("id").alias("actor_id"), F.col("email").alias("actor_email")), "actor_id", "left")


def dashboard(sites: DataFrame, grants: DataFrame, surveys: DataFrame, assets: DataFrame, clients: DataFrame, viewer: Viewer) -> DataFrame:
    """A row for each visible site: its client, surveys, latest flight and assets. One plan in place of a query per site."""
    seen = visible_sites(sites, grants, viewer)
    flown = surveys.groupBy(F.col("site_id").alias("id")).agg(F.count(F.lit(1)).alias("n_surveys"), F.max("flown_on").alias("last_flown"))
    held = (assets if viewer.is_owner else assets.where("is_published")).groupBy(F.col("site_id").alias("id")).agg(F.count(F.lit(1)).alias("n_assets"))
    out = seen.join(flown, "id", "left").join(held, "id", "left").fillna(0, ["n_surveys", "n_assets"])
    return out.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id", "left")


def active_user(users: DataFrame, email: str) -> DataFrame:
    """The active user with an email, whatever its case or outer spaces; the smallest id of several."""
    return users.where((F.lower("email") == F.lower(F.trim(F.lit(email)))) & F.col("is_active")).orderBy("id").limit(1)


def sign_in(users: DataFrame, arrivals: DataFrame, owners: list[str]) -> DataFrame:
    """What becomes of arrivals(email, full_name): (email, id, decision).

    owner_promoted for an owner's address, refused for a deactivated user, pending_created for a new one, else touched.
    """
    mail = F.lower(F.trim("email"))
    known = users.select(F.lower("email").alias("email"), "id", "is_active", "role")
    found = arrivals.select(mail.alias("email")).distinct().join(known, "email", "left")
    owner = F.col("email").isin([o.lower() for o in owners])
    decision = F.when(owner & (F.col("id").isNull() | (F.col("role") == "client") | ~F.col("is_active")), "owner_promoted").when(F.col("id").isNull(), "pending_created").when(~F.col("is_active"), "refused").otherwise("touched")
    return found.select("email", "id", decision.alias("decision"))


def valid_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions(user_id, client_id) whose user is active and still of the same client."""
    live = users.where("is_active").select(F.col("id").alias("user_id"), F.col("client_id").alias("now"))
    return sessions.join(live, "user_id").where(F.col("client_id").eqNullSafe(F.col("now"))).select(*sessions.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], identity: str = "id", keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The table after incoming rows took the place of those with equal natural keys, which keep their identity and `keep`.

    One full outer join; with repeated incoming keys the largest row by all columns counts, so that a rerun gives the same.
    """
    from pyspark.sql import Window

    fresh = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in incoming.columns if c not in keys]))).where("_n = 1").drop("_n")
    old, new = existing.alias("old"), fresh.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    arrived = F.col("new._new").isNotNull()
    both = old.join(fresh.withColumn("_new", F.lit(True)).alias("new"), on, "full_outer")
    out = []
    for c in existing.columns:
        first = F.col(f"old.{c}")
        if c not in fresh.columns:
            out.append(first.alias(c))
        elif c in (identity, *keep):
            out.append(F.coalesce(first, F.col(f"new.{c}")).alias(c))
        else:
            out.append(F.when(arrived, F.col(f"new.{c}")).otherwise(first).alias(c))
    return both.select(*out)


def retire_missing(existing: DataFrame, produced: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """existing with is_published false where a row in scope isn't among the produced keys any more."""
    made = produced.select(*keys).distinct().withColumn("_made", F.lit(True))
    marked = existing.join(made, keys, "left")
    return marked.withColumn("is_published", F.when(scope & F.col("_made").isNull(), False).otherwise(F.col("is_published"))).select(*existing.columns)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing and the incoming rows whose keys it doesn't hold."""
    return existing.unionByName(incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def remove(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def pending(files: DataFrame, applied: DataFrame, key: str = "name") -> DataFrame:
    """Names not applied yet, each once."""
    return files.select(key).distinct().join(applied.select(key), key, "left_anti")


def narrow(table: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Rows whose key is among the targets' ids."""
    return table.join(targets.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def violations(users: DataFrame, clients: DataFrame, sites: DataFrame, assets: DataFrame, grants: DataFrame) -> DataFrame:
    """(rule, n): rows against each constraint of the catalogue; a rule without any has 0."""
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    repeated = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    orphans = lambda df, key, parent: df.where(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)), key, "left_anti")
    placed = broadcast_below(sites.select("id"), SITE_ROWS)  # assets and grants stay where they are
    rules = [
        count(repeated(users, F.lower("email")), "users_email_unique"), count(repeated(sites, "client_id", "slug"), "sites_slug_unique"), count(repeated(assets, "storage_key"), "assets_key_unique"),
        count(repeated(grants, "user_id", "site_id"), "grants_unique"), count(orphans(users, "client_id", clients), "users_client_exists"), count(orphans(sites, "client_id", clients), "sites_client_exists"),
        count(orphans(assets, "site_id", placed), "assets_site_exists"), count(orphans(grants, "site_id", placed), "grants_site_exists"), count(orphans(grants, "user_id", users), "grants_user_exists"),
        count(users.where((F.col("role") != "client") & F.col("client_id").isNotNull()), "owner_without_client"), count(assets.where(~F.col("category").isin(*CATEGORIES)), "assets_category_known"),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def publish_errors(assets: DataFrame, site_prefix: Column) -> DataFrame:
    """(storage_key, error): everything wrong with assets about to be published, a row for each fault."""
    key = F.col("storage_key")
    faults = F.array(
        F.when(~F.col("category").isin(*CATEGORIES), F.concat(F.lit("unknown category "), F.col("category"))), F.when(~F.col("mime_type").isin(*MIME_TYPES), F.concat(F.lit("unknown type "), F.col("mime_type"))),
        F.when(~key_within(key, site_prefix), "storage key outside the site"),
    )
    return assets.select("storage_key", F.explode(F.array_compact(faults)).alias("error"))


def key_within(key: Column, prefix: Column) -> Column:
    """Is a storage key below a prefix, without a way out of it?"""
    lowered = F.lower(key)
    bad = key.contains("..") | key.contains("\\") | key.startswith("/") | lowered.contains("%2e") | lowered.contains("%2f") | ~key.rlike(r"^[A-Za-z0-9._/\-]+$")
    return ~bad & key.startswith(prefix)
