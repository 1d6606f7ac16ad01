"""Who may see which rows, as SQL: a session variable for the reader, a function that asks the list, and views with a policy.

What is set up here holds for any ``spark.sql`` of the session on those views, and shows in its plans as semi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VARIABLE, FUNCTION = "reader_email", "is_allowed_reader"


def set_reader(spark: SparkSession, email: str | None) -> None:
    """The reader of the statements that follow; None is nobody."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING DEFAULT NULL")
    spark.sql(f"SET VAR {VARIABLE} = :email", args={"email": email})


def allow_readers(spark: SparkSession, allowed: DataFrame, readers: DataFrame) -> None:
    """allowed: email in lower case; readers: user_id, email. The function is true for an address that is allowed, whatever its case, never for null."""
    allowed.select("email").createOrReplaceTempView("allowed_reader_emails")
    readers.select("user_id", "email").createOrReplaceTempView("known_readers")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {FUNCTION}(address STRING) RETURNS BOOLEAN RETURN EXISTS (SELECT 1 FROM allowed_reader_emails WHERE email = lower(address))")


def protect(spark: SparkSession, rows: DataFrame, view: str, owner: str | None = None) -> None:
    """The view has rows for an allowed reader only; with owner, a column with a user_id, only the reader's own."""
    rows.createOrReplaceTempView(f"all_{view}")
    own = f" AND {owner} IN (SELECT user_id FROM known_readers WHERE lower(email) = lower(session.{VARIABLE}))" if owner else ""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT * FROM all_{view} WHERE {FUNCTION}(session.{VARIABLE}){own}")
