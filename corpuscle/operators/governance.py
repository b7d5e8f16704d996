"""Roles, visibility of sensitive rows, audit rows, and status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ["user", "sysadmin", "secadmin", "audadmin"]
# fixed values: who may do what
MATRIX = {
    "read": ["user", "sysadmin", "secadmin", "audadmin"],
    "write": ["user", "sysadmin", "secadmin"],
    "monitor": ["sysadmin", "secadmin", "audadmin"],
    "secadmin_only": ["secadmin"],
    "sysadmin_only": ["sysadmin"],
    "audit": ["audadmin"],
}
ACTIONS = ["login", "create_document", "retry_document", "delete_document", "upload_kb_file", "delete_kb_file", "set_sensitive", "create_user", "update_user", "reset_password"]


def matrix(spark: SparkSession) -> DataFrame:
    """(permission, role) of all that is allowed."""
    pairs = [F.struct(F.lit(p).alias("permission"), F.lit(r).alias("role")) for p, roles in MATRIX.items() for r in roles]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def allowed(users: DataFrame, permission: str) -> DataFrame:
    """Active users whose registered role has the permission."""
    roles = F.broadcast(matrix(users.sparkSession).filter(F.col("permission") == permission).select("role"))  # four rows at most
    return users.filter("is_active").join(roles, "role", "left_semi")


def effective_roles(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests by user name with the role the registry knows; unknown and inactive users are rejected."""
    return requests.drop("role").join(users.filter("is_active").select("username", "role"), "username")


def visible(files: DataFrame, role: str) -> DataFrame:
    """Sensitive rows are the security administrator's alone."""
    return files if role == "secadmin" else files.filter(~F.coalesce(F.col("sensitive"), F.lit(False)))


def may_touch(files: DataFrame, role: str) -> DataFrame:
    """(filename, permitted) for reading or deleting single files."""
    return files.select("filename", (~F.coalesce(F.col("sensitive"), F.lit(False)) | F.lit(role == "secadmin")).alias("permitted"))


def audit_rows(events: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Audit rows out of (username, action, target, detail, ip, ok): flags as 1 and 0, unknown users with a blank role."""
    rows = events if users is None else events.join(users.select("username", "role"), "username", "left")
    role = F.coalesce("role", F.lit("")) if "role" in rows.columns else F.lit("")
    return rows.select(F.current_timestamp().alias("ts"), F.coalesce("username", F.lit("")).alias("username"), role.alias("role"), "action", *[F.coalesce(c, F.lit("")).alias(c) for c in ("target", "detail", "ip")], F.col("ok").cast("int").alias("success"))


def unknown_actions(rows: DataFrame) -> DataFrame:
    """Audit rows of an action that is not among ACTIONS: there should be none."""
    return rows.filter(~F.coalesce(F.col("action").isin(ACTIONS), F.lit(False)))


def append_audit(rows: DataFrame, path: str) -> bool:
    """Append to the log; a failure is reported, never raised, so that it cannot undo what it tells of."""
    try:
        rows.write.mode("append").parquet(path)
    except Exception:  # noqa: BLE001
        return False
    return True


def change_text(fields: dict[str, Column]) -> Column:
    """'k=v' of the fields that are set, joined by commas."""
    return F.concat_ws(",", *[F.when(c.isNotNull(), F.concat(F.lit(k + "="), c.cast("string"))) for k, c in fields.items()])


def health(registry: Column, chat: Column, report: Column, index: Column) -> Column:
    """ok only if registry, both engines and the index are; an index that still loads does not degrade."""
    return F.when(registry & chat & report & index.isin("ok", "loading"), "ok").otherwise("degraded")


def engine_status(chat: Column, report: Column) -> Column:
    return F.when(chat & report, "both engines are ready").when(chat, "only chat is ready").when(report, "only reports are ready").otherwise("no engine is reachable")


def self_edit(admin: Column, target: Column) -> Column:
    """An administrator may not edit the own account."""
    return admin == target
