"""Relational tables over JDBC, read in parallel."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def split_address(address: str) -> tuple[str, str]:
    """``connection::table`` into its two parts."""
    connection, mark, table = address.rpartition("::")
    if not mark or not connection or not table:
        raise ValueError("expected connection::table")
    return connection, table


def jdbc_url(connection: str) -> str:
    if connection.startswith("jdbc:"):
        return connection
    if connection.startswith("postgres://"):
        connection = "postgresql://" + connection[len("postgres://"):]
    return f"jdbc:{connection}"


def split_credentials(url: str) -> tuple[str, str | None, str | None]:
    """A JDBC address without ``user:password@``, which the driver does not read there, and both of them."""
    head, mark, rest = url.partition("://")
    host, slash, tail = rest.partition("/")
    given, at, place = host.rpartition("@")
    if not at:
        return url, None, None
    user, colon, password = given.partition(":")
    return f"{head}{mark}{place}{slash}{tail}", unquote(user), unquote(password) if colon else None


def jdbc_options(connection: str, table: str, partition_column: str | None = None, lower: object = None,
                 upper: object = None, partitions: int | None = None, **properties: str) -> dict[str, str]:
    """Reader options; with a partition column the table is read in parallel ranges."""
    url, user, password = split_credentials(jdbc_url(connection))
    given = {k: v for k, v in (("user", user), ("password", password)) if v is not None}
    options = {"url": url, "dbtable": table, "fetchsize": "10000", **given, **properties}
    if partition_column is not None:
        if lower is None or upper is None or not partitions:
            raise ValueError("a partition column needs its bounds and a partition count")
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_table(spark: SparkSession, connection: str, table: str, **options) -> DataFrame:
    """A table with its database types; filters and column lists are pushed to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(connection, table, **options)).load()


def read_table_split(spark: SparkSession, connection: str, table: str, column: str, partitions: int,
                     **properties: str) -> DataFrame:
    """Read in parallel over the range a numeric or temporal column has, asked from the database first."""
    bounds = read_table(spark, connection,
                        f"(SELECT min({column}) AS low, max({column}) AS high FROM {table}) AS bounds",
                        **properties).first()
    if bounds["low"] is None:
        return read_table(spark, connection, table, **properties)
    return read_table(spark, connection, table, partition_column=column, lower=bounds["low"], upper=bounds["high"],
                      partitions=partitions, **properties)
