"""Options for Spark's JDBC reader. Drivers are supplied on the cluster's class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names of the supported databases with their default ports.
DEFAULT_PORTS = {"postgres": 5432, "mysql": 3306, "mssql": 1433, "oracle": 1521, "snowflake": 443}
ALIASES = {"postgresql": "postgres", "sqlserver": "mssql"}
DRIVERS = {
    "postgres": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
}
FETCH_SIZE = 100

# declared foreign keys, as the database's own catalog lists them
CONSTRAINT_QUERIES = {
    # key columns are matched by their place in the key, so a key of n columns gives n rows
    "postgres": (
        "SELECT own.table_schema AS source_schema, own.table_name AS source_table, own.column_name AS source_column, "
        "far.table_schema AS target_schema, far.table_name AS target_table, far.column_name AS target_column FROM information_schema.referential_constraints rc "
        "JOIN information_schema.key_column_usage own ON own.constraint_schema = rc.constraint_schema AND own.constraint_name = rc.constraint_name "
        "JOIN information_schema.key_column_usage far ON far.constraint_schema = rc.unique_constraint_schema AND far.constraint_name = rc.unique_constraint_name "
        "AND far.ordinal_position = own.position_in_unique_constraint"),
    "mysql": (
        "SELECT table_name AS source_table, column_name AS source_column, referenced_table_name AS target_table, "
        "referenced_column_name AS target_column FROM information_schema.key_column_usage WHERE referenced_table_name IS NOT NULL"),
    "mssql": (
        "SELECT OBJECT_NAME(parent_object_id) AS source_table, COL_NAME(parent_object_id, parent_column_id) AS source_column, "
        "OBJECT_NAME(referenced_object_id) AS target_table, COL_NAME(referenced_object_id, referenced_column_id) AS target_column "
        "FROM sys.foreign_key_columns"),
}


def canonical_kind(kind: str) -> str:
    name = ALIASES.get(kind.lower(), kind.lower())
    if name not in DEFAULT_PORTS:
        raise ValueError(f"unknown database kind {kind!r}; known: {sorted(DEFAULT_PORTS)}")
    return name


def jdbc_url(kind: str, host: str, database: str, port: int | None = None) -> str:
    name = canonical_kind(kind)
    port = port or DEFAULT_PORTS[name]
    return {
        "postgres": f"jdbc:postgresql://{host}:{port}/{database}",
        "mysql": f"jdbc:mysql://{host}:{port}/{database}",
        "mssql": f"jdbc:sqlserver://{host}:{port};databaseName={database}",
        "oracle": f"jdbc:oracle:thin:@//{host}:{port}/{database}",
        "snowflake": f"jdbc:snowflake://{host}:{port}/?db={database}",
    }[name]


def jdbc_options(
    kind: str, host: str, database: str, table: str | None = None, query: str | None = None, port: int | None = None,
    partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1, **extra: str,
) -> dict[str, str]:
    """Reader options. A partitioned read needs a column and its bounds; Spark forbids it with ``query``."""
    if (table is None) == (query is None):
        raise ValueError("give either table or query")
    options = {"url": jdbc_url(kind, host, database, port), "driver": DRIVERS[canonical_kind(kind)], "fetchsize": str(FETCH_SIZE)}
    if partition_column:
        if bounds is None or partitions < 2:
            raise ValueError("a partitioned read needs bounds and at least 2 partitions")
        options["dbtable"] = table if table else f"({query}) q"
        options |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
                    "numPartitions": str(partitions)}
    elif query:
        options["query"] = query
    else:
        options["dbtable"] = table
    return options | extra


def read_jdbc(spark: SparkSession, kind: str, host: str, database: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, host, database, **options)).load()


def read_constraints(spark: SparkSession, kind: str, host: str, database: str, **options) -> DataFrame:
    """Declared foreign keys; empty for databases whose catalog is not read."""
    query = CONSTRAINT_QUERIES.get(canonical_kind(kind))
    if query is None:
        return spark.createDataFrame([], "source_table string, source_column string, target_table string, target_column string")
    return read_jdbc(spark, kind, host, database, query=query, **options)
