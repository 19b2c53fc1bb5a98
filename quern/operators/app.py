"""The queries of the application's store: rooms, messages, verification codes, sign-up rules, a work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the rule of passwords.
PASSWORD = r"^(?=.*[A-Za-z])(?=.*[0-9])(?=.*[^A-Za-z0-9]).{8,}$"


def latest(df: DataFrame, keys: list[str], at: str, ident: str) -> DataFrame:
    """The last row of each key, ties to the greater id."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(ident)))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth")


def recent(df: DataFrame, keys: list[str], at: str, ident: str, n: int = 5) -> DataFrame:
    """The n newest rows of each key with their rank, ties to the smaller id."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), ident))
    return df.withColumn("nth", nth).where(F.col("nth") <= n)


def oldest_pending(queue: DataFrame, status: str = "pending") -> DataFrame:
    return queue.where(F.col("status") == status).orderBy("created_at", "id").limit(1)


def with_status(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with the new states (id, new_status) of some rows."""
    return queue.join(done, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def owned(rooms: DataFrame, caller: str) -> DataFrame:
    return rooms.where(F.col("user_email") == caller)


def registered(emails: DataFrame, users: DataFrame) -> DataFrame:
    return emails.join(users.select("email"), "email", "left_semi")


def unregistered(emails: DataFrame, users: DataFrame) -> DataFrame:
    return emails.join(users.select("email"), "email", "left_anti")


def without_children(rows: DataFrame, key: str, doomed: DataFrame) -> DataFrame:
    """A cascade's step: rows whose key isn't among those that go."""
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def delete_user(users: DataFrame, codes: DataFrame, rooms: DataFrame, messages: DataFrame, email: str) -> dict[str, DataFrame]:
    """The four tables after a user's messages, rooms, codes and row are gone."""
    gone = rooms.where(F.col("user_email") == email).select(F.col("id").alias("room_id"))
    return {
        "messages": without_children(messages, "room_id", gone),
        "rooms": rooms.where(~F.col("user_email").eqNullSafe(F.lit(email))),
        "codes": codes.where(~F.col("email").eqNullSafe(F.lit(email))),
        "users": users.where(~F.col("email").eqNullSafe(F.lit(email))),
    }


def password_ok(password: Column) -> Column:
    return password.rlike(PASSWORD)


def code_ok(code: Column) -> Column:
    return code.rlike("^[0-9]{6}$")


def not_blank(x: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) > 0, F.lit(False))


def verification_outcome(code: Column, stored: Column, expires_at: Column, now: Column) -> Column:
    """Why a code is refused, or ok; the first reason that holds."""
    return F.when(stored.isNull(), "no code").when(expires_at < now, "expired").when(code != stored, "wrong code").otherwise("ok")


def signup_outcome(email, name, password, again, verified, terms, taken) -> Column:
    blank = ~not_blank(email) | ~not_blank(name) | ~not_blank(password)
    return (
        F.when(blank, "blank").when(~terms, "terms").when(~verified, "unverified").when(taken, "registered")
        .when(~password_ok(password), "password").when(password != again, "different").otherwise("ok")
    )
