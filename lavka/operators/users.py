"""User registration and sign-in as batch jobs."""

from pyspark.sql import functions as F

from lavka.functions.roles import capabilities, role_title
from lavka.functions.text import display_name, secret_hash, strip
from lavka.operators.numbering import last_key, number_rows
from lavka.operators.sizing import lookup_side

REGISTERED = ["user_role", "user_name", "user_login", "user_secret"]


def new_users(cleaned, users, numbered=None):
    """Users to add: the first row of each login that is not taken yet.

    The first row number of a login is found by an aggregate that combines before
    the shuffle; no login is gathered in one place. Row numbers are unique, so they
    find the rows. Ids follow the row order and go on from the largest in
    ``numbered`` (default: ``users``).
    """
    first = cleaned.groupBy("user_login").agg(F.min("row_no").alias("row_no"))
    taken = users.select(F.trim("user_login").alias("user_login")).distinct()
    rows = first.join(taken, "user_login", "left_anti").select("row_no")
    fresh = cleaned.join(lookup_side(rows, "row_no"), "row_no", "left_semi")
    return number_rows(fresh, "row_no", "user_id", last_key(users if numbered is None else numbered, "user_id")).select(
        "row_no", "user_id", *REGISTERED
    )


def signin_matches(attempts, users, salt):
    """Each attempt (attempt_id, login, secret) with the user it matches, if any.

    Login and secret match after trimming; of several users the smallest id.
    The secret is only compared as its salted hash and never returned.
    """
    accounts = users.groupBy(F.trim("user_login").alias("login"), "user_secret").agg(
        F.min("user_id").alias("user_id")
    )
    named = users.select("user_id", F.col("user_name").alias("full_name"), F.col("user_role").alias("role_name"))
    tried = attempts.select(
        "attempt_id",
        strip(F.col("login")).alias("login"),
        secret_hash(F.col("login"), F.col("secret"), salt).alias("user_secret"),
    )
    return tried.join(
        lookup_side(accounts, "login", "user_secret"), ["login", "user_secret"], "left"
    ).join(named, "user_id", "left").select(
        "attempt_id", "login", "user_id", "full_name", "role_name", F.col("user_id").isNotNull().alias("matched"),
    )


def entitlements(users):
    """Users without their secret: shown name, role title and what they may do."""
    return users.select(
        "user_id",
        F.col("user_login").alias("login"),
        display_name(F.col("user_name")).alias("full_name"),
        F.col("user_role").alias("role_name"),
        role_title(F.col("user_role")).alias("role_title"),
        *capabilities(F.col("user_role")),
    )
