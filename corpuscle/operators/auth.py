"""Passwords, tokens and logins as columns.

Tokens (JWT, HS256) are made and checked by built-in hashes alone; passwords (PBKDF2) need Python.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the form of a stored password
SCHEME, ITERATIONS = "pbkdf2_sha256", 200_000
HEADER = '{"alg":"HS256","typ":"JWT"}'


def password_hash(password: str, iterations: int = ITERATIONS, salt: bytes | None = None) -> str:
    """scheme$iterations$salt$key, the last two in base64."""
    salt = os.urandom(16) if salt is None else salt
    key = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations)
    return "$".join([SCHEME, str(iterations), base64.b64encode(salt).decode(), base64.b64encode(key).decode()])


def password_fits(password: str | None, stored: str | None) -> bool:
    """Whether a password is the stored one; what can't be read fits nothing."""
    try:
        scheme, iterations, salt, key = stored.split("$")
        own = hashlib.pbkdf2_hmac("sha256", password.encode(), base64.b64decode(salt), int(iterations))
        return scheme == SCHEME and hmac.compare_digest(own, base64.b64decode(key))
    except (AttributeError, ValueError):
        return False


def hashed(password: Column, iterations: int = ITERATIONS) -> Column:
    @F.pandas_udf("string")
    def run(passwords: pd.Series) -> pd.Series:
        return passwords.map(lambda p: None if p is None else password_hash(p, iterations))

    return run(password)


def fits(password: Column, stored: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(passwords: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([password_fits(p, s) for p, s in zip(passwords, known, strict=True)], dtype=bool)

    return run(password, stored)


def _base64url(raw: Column) -> Column:
    return F.rtrim(F.translate(F.base64(raw), "+/\r\n", "-_"), F.lit("="))


def _hmac_sha256(message: Column, secret: str) -> Column:
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256))


def token(username: Column, role: Column, issued: Column, minutes: int, secret: str) -> Column:
    """A signed token; issued: seconds since 1970."""
    claims = F.to_json(F.struct(username.alias("sub"), role.alias("role"), issued.cast("long").alias("iat"), (issued.cast("long") + 60 * minutes).alias("exp")))
    body = F.concat(_base64url(F.lit(HEADER).cast("binary")), F.lit("."), _base64url(claims.cast("binary")))
    return F.concat(body, F.lit("."), _base64url(_hmac_sha256(body, secret)))


def claims(tokens: Column, now: Column, secret: str) -> Column:
    """(sub, role, iat, exp) of a token, or null where its signature or form is wrong or its time is over."""
    parts = F.split(tokens, r"\.")
    body = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    plain = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    said = F.from_json(F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string"), "sub string, role string, iat long, exp long")
    signed = (F.size(parts) == 3) & F.get(parts, F.lit(2)).eqNullSafe(_base64url(_hmac_sha256(body, secret)))
    return F.when(signed & (said["exp"] > now.cast("long")), said)


def logins(attempts: DataFrame, users: DataFrame, password_ok: Column) -> DataFrame:
    """Attempts (username, ...) with role, ok, and what the log says; a wrong password and an unknown or inactive user look alike.

    password_ok: a condition on columns of attempts and of users, such as fits(F.col("password"), F.col("password_hash")).
    """
    known = users.withColumnsRenamed({"role": "_role", "is_active": "_active"})
    joined = attempts.join(known, "username", "left")
    ok = F.coalesce(F.col("_active") & password_ok, F.lit(False))
    role = F.when(F.col("_active"), F.col("_role")).otherwise("")
    return joined.select(*attempts.columns, F.coalesce(role, F.lit("")).alias("role"), ok.alias("ok"), F.lit("login").alias("action"), F.when(ok, "").otherwise("wrong name or password").alias("detail"))
