"""Scope filters, provenance-derived claim scope, and access policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scope columns, and what an absent or blank value stands for.
DEFAULTS = {"namespace_slug": "default", "namespace_sharing_mode": "private", "app_client_name": "legacy_client", "app_client_type": "python_sdk", "project_slug": "default", "project_display_name": "default"}
FIELDS = [
    "namespace_slug", "namespace_sharing_mode", "app_client_name", "app_client_type", "app_client_provider", "app_client_external_key", "agent_name", "agent_external_key",
    "session_external_key", "session_kind", "project_slug", "project_display_name", "project_root_uri", "project_repo_remote", "project_default_branch",
]
EQUALITY_KEYS = ["namespace_slug", "project_slug", "app_client_name", "app_client_type", "app_client_provider", "app_client_external_key", "agent_name", "agent_external_key", "session_external_key", "session_kind"]
EXACT_KEYS = [*EQUALITY_KEYS, "namespace_sharing_mode"]
LEGACY = {"namespace_slug": "default", "project_slug": "default", "app_client_name": "legacy_client", "app_client_type": "python_sdk"}
VISIBILITY = ("private", "project", "namespace")
#: Columns that hold places, whose spellings are made one.
PLACES = ("project_root_uri", "project_repo_remote")


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def equality(scope: Mapping[str, str | None] | None, prefix: str = "") -> Column:
    """Rows whose given keys equal the scope's; keys without a value restrict nothing, null never matches."""
    return _all([F.coalesce(F.col(prefix + k) == v, F.lit(False)) for k, v in (scope or {}).items() if v is not None and k in EQUALITY_KEYS])


def exact(scope: Mapping[str, str | None], keys: Sequence[str] = tuple(EXACT_KEYS)) -> Column:
    """Rows that have just this scope: keys without a value must be null."""
    return _all([F.col(k).eqNullSafe(F.lit(scope.get(k))) for k in keys])


def one_spelling(place):
    """A place with forward slashes, none at its end, and a small drive letter."""
    plain = F.regexp_replace(F.translate(place, "\\", "/"), "/+$", "")
    return F.when(F.substring(plain, 2, 1) == ":", F.concat(F.lower(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 30))).otherwise(plain)


def with_defaults(df: DataFrame) -> DataFrame:
    """Scope columns trimmed, blanks replaced by their defaults or null, missing columns added."""
    have = set(df.columns)
    given = {f: F.nullif(F.trim(F.col(f)), F.lit("")) if f in have else F.lit(None).cast("string") for f in FIELDS}
    return df.withColumns({f: F.coalesce(one_spelling(c) if f in PLACES else c, F.lit(DEFAULTS.get(f)).cast("string")) for f, c in given.items()})


def key() -> Column:
    """One string for a row's scope, by the columns that keep scopes apart; null and blank are alike."""
    return F.concat_ws("|", *[F.replace(F.coalesce(F.col(k), F.lit(DEFAULTS.get(k, ""))), F.lit("|"), F.lit("||")) for k in EQUALITY_KEYS])


#: The scope of rows without any scope columns set.
DEFAULT_KEY = "|".join(DEFAULTS.get(k, "") for k in EQUALITY_KEYS)


def claim_key(claim: Column, scope_key: Column) -> Column:
    """The id of a claim in its scope: two scopes that learn one thing hold a claim each. The default scope's is the claim's own id."""
    own = F.concat(F.lit("clm_"), F.substring(F.sha2(F.concat_ws("|", scope_key, claim), 256), 1, 32))
    return F.when((scope_key == DEFAULT_KEY) | claim.isNull(), claim).otherwise(own)


def of_clusters(members: DataFrame) -> DataFrame:
    """(cluster, scope columns): a column's one value in the cluster; where there are several, the smallest id's for the
    columns that keep scopes apart, null for the others."""
    first = F.min_by(F.struct(*FIELDS), "id").alias("first")
    spread = [F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in FIELDS]
    rows = with_defaults(members).groupBy("cluster").agg(first, *spread)
    pick = lambda f: F.when(F.col(f)["lo"] == F.col(f)["hi"], F.col(f)["lo"]).otherwise(F.col("first")[f] if f in EXACT_KEYS else F.lit(None))
    return rows.select("cluster", *[pick(f).alias(f) for f in FIELDS])


@dataclass(frozen=True)
class Scope:
    """A caller's resolved scope."""

    namespace_slug: str = "default"
    project_slug: str = "default"
    app_client_name: str = "legacy_client"
    app_client_type: str = "python_sdk"
    app_client_provider: str | None = None
    app_client_external_key: str | None = None
    agent_name: str | None = None
    agent_external_key: str | None = None
    session_external_key: str | None = None
    session_kind: str | None = None
    namespace_sharing_mode: str = "private"
    read_visibility: str = "private"
    write_mode: str = "allow"

    def __post_init__(self) -> None:
        if self.read_visibility not in VISIBILITY:
            raise ValueError(f"read_visibility must be one of {VISIBILITY}")
        if self.write_mode not in ("allow", "deny"):
            raise ValueError("write_mode must be allow or deny")

    def read_filter(self) -> dict[str, str | None]:
        """Keys that restrict reads: wider visibility restricts fewer; shared namespaces drop the application."""
        out: dict[str, str | None] = {"namespace_slug": self.namespace_slug}
        if self.read_visibility == "namespace":
            return out
        out["project_slug"] = self.project_slug
        if self.read_visibility == "project" or self.namespace_sharing_mode != "private":
            return out
        return out | {k: getattr(self, k) for k in EQUALITY_KEYS if k not in out}

    def mutation_filter(self) -> dict[str, str | None]:
        """Writes reach exactly this namespace, project and application, whatever may be read."""
        return {k: getattr(self, k) for k in ("namespace_slug", "project_slug", "app_client_name", "app_client_type", "app_client_provider", "app_client_external_key")}

    def require_write(self) -> None:
        if self.write_mode == "deny":
            raise PermissionError(f"writes are denied in {self.namespace_slug}/{self.project_slug}")


def coerce(value: Scope | Mapping[str, object] | str | None) -> Scope:
    """A scope from nested or flat keys, or from a 'namespace/project' string."""
    if value is None:
        return Scope()
    if isinstance(value, Scope):
        return value
    if isinstance(value, str):
        first, _, second = value.strip().partition("/")
        return Scope(namespace_slug=first, project_slug=second) if second else Scope(project_slug=first or "default")
    flat: dict[str, str] = {}
    nested = {"namespace": {"slug": "namespace_slug", "sharing_mode": "namespace_sharing_mode"}, "project": {"slug": "project_slug"}, "app_client": {x: f"app_client_{x}" if x != "app_type" else "app_client_type" for x in ("name", "app_type", "provider", "external_key")}, "agent": {"name": "agent_name", "external_key": "agent_external_key"}, "session": {"external_key": "session_external_key", "session_kind": "session_kind"}, "policy": {"read_visibility": "read_visibility", "write_mode": "write_mode"}}
    for key, inner in value.items():
        if key in nested:
            if not isinstance(inner, Mapping):
                raise ValueError(f"{key} must be a mapping")
            unknown = set(inner) - set(nested[key])
            if unknown:
                raise ValueError(f"unknown keys in {key}: {sorted(unknown)}")
            flat |= {nested[key][k]: str(v).strip() for k, v in inner.items() if v is not None and str(v).strip()}
        elif key in Scope.__dataclass_fields__:
            if inner is not None and str(inner).strip():
                flat[key] = str(inner).strip()
        else:
            raise ValueError(f"unknown scope key: {key}")
    return replace(Scope(), **flat)


def audit_filter(default: Scope, scope: object = None, everything: bool = False) -> dict[str, str | None] | None:
    """What audits look at: all rows, the given scope, or the caller's own."""
    return None if everything else (coerce(scope) if scope is not None else default).read_filter()


def left_join(rows: DataFrame, more: DataFrame, key: str, spread: str = "claim_id") -> DataFrame:
    """Left join by a key that many rows lack: those go to partitions by `spread`, where a plain join deals all of them to one task."""
    own = F.xxhash64(F.col(key).cast("string"))  # not a constant: Catalyst would take it out of the join's keys
    held = rows.withColumn("__spread", F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(own))
    return held.join(more.withColumn("__spread", own), [key, "__spread"], "left").drop("__spread")


def source_scopes(sources: DataFrame, episodes: DataFrame, records: DataFrame, topics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scope of each provenance row: of its episode, else its record, else its topic. Rows without one of these are spread, not joined in one task."""
    e = episodes.select(F.col("id").alias("source_episode_id"), *[F.col(k).alias(f"e_{k}") for k in keys])
    r = records.select(F.col("id").alias("source_record_id"), *[F.col(k).alias(f"r_{k}") for k in keys])
    t = topics.select(F.col("id").alias("source_topic_id"), *[F.col(k).alias(f"t_{k}") for k in keys])
    joined = left_join(left_join(left_join(sources, e, "source_episode_id"), r, "source_record_id"), t, "source_topic_id")
    return joined.select("claim_id", *[F.coalesce(f"e_{k}", f"r_{k}", f"t_{k}").alias(k) for k in keys])


def claims_in_scope(claims: DataFrame, scoped_sources: DataFrame, scope: Mapping[str, str | None] | None) -> DataFrame:
    """Claims all of whose provenance rows are in scope; claims without any only for the legacy default scope."""
    if not scope:
        return claims
    inside = scoped_sources.groupBy(F.col("claim_id").alias("id")).agg(F.every(equality(scope)).alias("inside"))
    own = claims.join(inside.filter("inside").select("id"), "id", "left_semi")
    if all(scope.get(k) == v for k, v in LEGACY.items()) and not any(v for k, v in scope.items() if k not in LEGACY):
        return own.unionByName(claims.join(inside.select("id"), "id", "left_anti"))
    return own


def matching_acl(entries: DataFrame, policies: DataFrame, principals: DataFrame, scope: Mapping[str, str | None], who: Sequence[tuple[str, str]]) -> DataFrame:
    """Entries of enabled policies whose selectors are null or equal the scope's, for the caller's principals."""
    tests = [F.col(k).isNull() | (F.col(k) == F.lit(scope.get(k))) for k in ("namespace_slug", "project_slug") if k in policies.columns]
    mine = reduce(lambda a, b: a | b, [(F.col("principal_type") == t) & (F.col("principal_key") == k) for t, k in who], F.lit(False))
    p = policies.filter(F.col("enabled") & _all(tests)).select(F.col("id").alias("policy_id"))
    q = principals.filter(mine).select(F.col("id").alias("principal_id"), "principal_type", "principal_key")
    return entries.join(p, "policy_id").join(q, "principal_id")


def effective_policy(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Deny overrides allow; the most restrictive visibility wins."""
    rank = F.array_position(F.array(*[F.lit(v) for v in VISIBILITY]), F.col("read_visibility"))
    out = entries.groupBy(*by).agg(F.bool_or(F.col("write_mode") == "deny").alias("denied"), F.min(F.when(rank > 0, rank)).alias("rank"), F.count("*").alias("matched_entries"))
    return out.select(*by, F.when(F.col("denied"), "deny").otherwise("allow").alias("write_mode"), F.element_at(F.array(*[F.lit(v) for v in VISIBILITY]), F.col("rank").cast("int")).alias("read_visibility"), "matched_entries")


def policy_listing(policies: DataFrame, entries: DataFrame, principals: DataFrame) -> DataFrame:
    """Policies with their entries and principals, where they have any."""
    e = entries.select(F.col("id").alias("entry_id"), "policy_id", "principal_id", "write_mode", "read_visibility")
    q = principals.select(F.col("id").alias("principal_id"), "principal_type", "principal_key")
    return policies.withColumnRenamed("id", "policy_id").join(e, "policy_id", "left").join(q, "principal_id", "left")
