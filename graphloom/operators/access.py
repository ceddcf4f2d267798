"""Workspace access and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access(workspaces: DataFrame, grants: DataFrame, user: str) -> DataFrame:
    """(workspace_id, role): what ``user`` may do: owner over grant over public reading; nothing else is listed."""
    own = grants.filter(F.col("principal") == user).groupBy("workspace_id").agg(F.max(F.when(F.col("role") == "writer", 2).otherwise(1)).alias("g"))
    rows = workspaces.join(own, "workspace_id", "left")
    role = F.when(F.col("owner") == user, "owner").when(F.col("g") == 2, "writer").when(F.col("g") == 1, "reader").when(F.col("public"), "reader")
    return rows.select("workspace_id", role.alias("role")).filter("role IS NOT NULL")


def can_write(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("role").isin("owner", "writer"))


def keyset_page(rows: DataFrame, key: str, after: str | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """(page, more): up to ``limit`` (1 to 100) rows after a cursor in key order; ``more`` has a row if others follow."""
    n = min(max(limit, 1), 100)
    rows = rows if after is None else rows.filter(F.col(key) > after)
    ahead = rows.orderBy(key).limit(n + 1)
    return ahead.orderBy(key).limit(n), ahead.orderBy(key).offset(n).limit(1)


def visible(rows: DataFrame, allowed: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """Rows of the workspaces that a user may read."""
    return rows.join(allowed.select(F.col("workspace_id").alias(workspace)), workspace, "left_semi")


# Categories of tools, which are also the scopes.
SCOPES = ("graph-read", "graph-write", "vectors", "code", "attachments")


def authenticated(requests: DataFrame, machines: DataFrame) -> DataFrame:
    """(request_id, principal_id, scopes) of requests (request_id, token) with the token of a machine that isn't revoked.

    ``machines`` (principal_id, name, scopes, token_digest, revoked) holds SHA-256 digests in hex, never tokens.
    """
    live = machines.filter(~F.col("revoked")).select("principal_id", "scopes", "token_digest")
    asked = requests.filter("token <> ''").select("request_id", F.sha2("token", 256).alias("token_digest"))
    return asked.join(live, "token_digest").select("request_id", "principal_id", "scopes")


def add_machines(machines: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(machines, refused): ``new`` (principal_id, name, scopes, token) stored by digest; refused without a name or with other scopes."""
    scopes = F.array_sort(F.array_distinct("scopes"))
    known = (F.size("scopes") > 0) & F.forall("scopes", lambda x: x.isNotNull() & x.isin(*SCOPES))
    ok = F.coalesce((F.trim("name") != "") & known, F.lit(False))
    rows = new.filter(ok).select("principal_id", F.trim("name").alias("name"), scopes.alias("scopes"), F.sha2("token", 256).alias("token_digest"), F.lit(False).alias("revoked"))
    return machines.select(rows.columns).union(rows), new.filter(~ok).select("principal_id")


def list_machines(machines: DataFrame) -> DataFrame:
    return machines.select("principal_id", "name", "scopes", "revoked").orderBy("principal_id")


def revoke_machines(machines: DataFrame, workspaces: DataFrame, grants: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(machines, grants) after ``gone`` (principal_id) are revoked and lose their grants; owners of a workspace are refused."""
    may = gone.filter(F.col("principal_id").startswith("machine:")).join(workspaces.select(F.col("owner").alias("principal_id")), "principal_id", "left_anti").distinct()
    may = machines.filter(~F.col("revoked")).select("principal_id").join(may, "principal_id", "left_semi").withColumn("__gone", F.lit(True))
    rows = machines.join(may, "principal_id", "left").withColumn("revoked", F.col("revoked") | F.col("__gone").isNotNull()).select(machines.columns)
    return rows, grants.join(may.select(F.col("principal_id").alias("principal")), "principal", "left_anti").select(grants.columns)


def allowed_calls(calls: DataFrame, principals: DataFrame, tools: DataFrame) -> DataFrame:
    """(call_id, allowed, missing): calls (call_id, principal_id, tool) whose principal has the tool's scope; ``missing`` names the scope.

    ``tools`` (tool, scope) is the list of tools; an unknown tool or principal is never allowed.
    """
    rows = calls.join(tools.select("tool", "scope"), "tool", "left").join(principals.select("principal_id", "scopes"), "principal_id", "left")
    has = F.coalesce(F.array_contains("scopes", F.col("scope")), F.lit(False))
    return rows.select("call_id", has.alias("allowed"), F.when(~has, F.col("scope")).alias("missing"))


# Updates by owners. A request has an id, its principal and its workspace; those that
# aren't allowed change nothing and are told in a report. Of several requests for the
# same record the last id wins.


def _owned(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """``requests`` (request_id, principal, workspace_id, ...) whose principal owns the workspace."""
    return requests.join(workspaces.select("workspace_id", F.col("owner").alias("principal")), ["workspace_id", "principal"], "left_semi")


def refused(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    return requests.select("request_id").join(allowed.select("request_id"), "request_id", "left_anti")


def grant(grants: DataFrame, requests: DataFrame, workspaces: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(grants, report): requests (..., grantee, role) give or replace a role of a registered principal other than the owner."""
    known = registered.select(F.col("principal").alias("grantee"))
    ok = _owned(requests, workspaces).filter(F.col("role").isin("reader", "writer") & (F.col("grantee") != F.col("principal"))).join(known, "grantee", "left_semi")
    new = ok.groupBy("workspace_id", F.col("grantee").alias("principal")).agg(F.max_by("role", "request_id").alias("role"))
    kept = grants.join(new, ["workspace_id", "principal"], "left_anti").select("workspace_id", "principal", "role")
    return kept.union(new.select(kept.columns)), refused(requests, ok)


def revoke(grants: DataFrame, defaults: DataFrame, requests: DataFrame, workspaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grants, defaults, report) after requests (..., grantee); a lost grant takes the default along, other defaults stay."""
    ok = _owned(requests, workspaces).filter(F.col("grantee") != F.col("principal"))
    gone = grants.join(ok.select("workspace_id", F.col("grantee").alias("principal")), ["workspace_id", "principal"], "left_semi").select("workspace_id", "principal")
    key = ["workspace_id", "principal"]
    return grants.join(gone, key, "left_anti").select(grants.columns), defaults.join(gone, key, "left_anti").select(defaults.columns), refused(requests, ok)


def set_visibility(workspaces: DataFrame, grants: DataFrame, defaults: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(workspaces, defaults, report) after requests (..., public); one made private is no default any more of those without owner's or granted access."""
    ok = _owned(requests, workspaces).filter("public IS NOT NULL")
    last = ok.groupBy("workspace_id").agg(F.max_by("public", "request_id").alias("__public"))
    rows = workspaces.join(last, "workspace_id", "left")
    after = rows.withColumn("public", F.coalesce("__public", "public")).select(workspaces.columns)
    key = ["workspace_id", "principal"]
    owners = workspaces.select("workspace_id", F.col("owner").alias("principal"))
    closed = last.filter("NOT __public").select("workspace_id")
    lost = defaults.join(closed, "workspace_id", "left_semi").join(owners, key, "left_anti").join(grants.select(key), key, "left_anti").select(key)
    return after, defaults.join(lost, key, "left_anti").select(defaults.columns), refused(requests, ok)


def rename(workspaces: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspaces, report) after requests (..., name): trimmed; an empty name and one that another workspace of the owner has are refused.

    Names are compared with those before the batch and, between requests, given to the
    smallest workspace_id that asks.
    """
    named = _owned(requests, workspaces).withColumn("name", F.trim("name")).filter("name <> ''")
    last = named.groupBy("principal", "workspace_id").agg(F.max(F.struct("request_id", "name")).alias("r")).select("principal", "workspace_id", "r.*")
    taken = workspaces.select(F.col("owner").alias("principal"), "name", F.col("workspace_id").alias("holder"))
    clash = last.join(taken, ["principal", "name"]).filter(F.col("holder") != F.col("workspace_id")).select("request_id")
    first = last.join(clash, "request_id", "left_anti").groupBy("principal", "name").agg(F.min(F.struct("workspace_id", "request_id")).alias("r")).select("name", "r.*")
    rows = workspaces.join(first.select("workspace_id", F.col("name").alias("__name")), "workspace_id", "left")
    return rows.withColumn("name", F.coalesce("__name", "name")).select(workspaces.columns), refused(requests, first)


def set_default(defaults: DataFrame, requests: DataFrame, workspaces: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defaults, report) after requests (request_id, principal, workspace_id): any workspace that the principal may read."""
    key = ["workspace_id", "principal"]
    may = workspaces.select("workspace_id", F.col("owner").alias("principal")).union(grants.select(key))
    public = workspaces.filter("public").select("workspace_id")
    ok = requests.join(may, key, "left_semi").select("request_id", *key).union(requests.join(public, "workspace_id", "left_semi").select("request_id", *key)).filter("principal IS NOT NULL").distinct()
    new = ok.groupBy("principal").agg(F.max_by("workspace_id", "request_id").alias("workspace_id"))
    kept = defaults.join(new, "principal", "left_anti").select("principal", "workspace_id")
    return kept.union(new), refused(requests, ok)


def create_workspaces(workspaces: DataFrame, requests: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workspaces, report): requests (request_id, principal, workspace_id, name, public) of registered owners; a name that the owner has already is refused, the first request of a name wins."""
    asked = requests.withColumn("name", F.trim("name")).filter("name <> '' AND workspace_id IS NOT NULL").join(registered.select("principal"), "principal", "left_semi")
    free = asked.join(workspaces.select(F.col("owner").alias("principal"), "name"), ["principal", "name"], "left_anti").join(workspaces.select("workspace_id"), "workspace_id", "left_anti")
    first = free.groupBy("principal", "name").agg(F.min(F.struct("request_id", "workspace_id", "public")).alias("r")).select("principal", "name", "r.*")
    rows = first.select("workspace_id", F.col("principal").alias("owner"), "name", F.coalesce("public", F.lit(False)).alias("public"))
    return workspaces.select(rows.columns).union(rows), refused(requests, first)
