"""Report tables in a database: created with primary keys, replaced in one transaction.

The executors write a replacement to a staging table that has the target's
columns and key, so a NULL or repeated key, or a task that was committed twice,
fails there.  Then one connection of the session's own JVM empties the target
and fills it from the staging table in a single transaction: readers see the
old rows or the new ones, a failure at any point leaves the old rows, and the
table with its grants and key stays.  No row passes through the driver.

Needs a classic session (the connection is opened in its JVM) and a driver on
its class path.  Identifiers are quoted by Spark's dialect of the database, as
its JDBC writer does.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEY_TEXT = "VARCHAR(1000)"      # most databases index no unbounded text
RETRIES = 5
# what Spark's writer creates where a database has no type of its own
COMMON_TYPES = {"string": "TEXT", "integer": "INTEGER", "long": "BIGINT", "double": "DOUBLE PRECISION",
                "float": "REAL", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


class Database:
    """Statements and whole-table replacements of one JDBC URL."""

    def __init__(self, spark: SparkSession, url: str, properties: Mapping[str, str] | None = None):
        self.spark, self.url, self.properties = spark, url, dict(properties or {})
        self._turn = threading.Lock()
        self._jvm = spark.sparkContext._jvm
        self._dialect = self._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)

    @contextmanager
    def connection(self):
        """A connection without auto-commit; rolled back when the block fails."""
        given = self._jvm.java.util.Properties()
        for key, value in self.properties.items():
            given.setProperty(key, value)
        name = self.properties.get("driver")
        if name:
            loader = self._jvm.java.lang.Thread.currentThread().getContextClassLoader()
            driver = loader.loadClass(name).newInstance()
        else:
            driver = self._jvm.java.sql.DriverManager.getDriver(self.url)
        conn = driver.connect(self.url, given)
        try:
            conn.setAutoCommit(False)
            yield conn
            conn.commit()
        except BaseException:
            conn.rollback()
            raise
        finally:
            conn.close()

    def execute(self, *statements: str, count: str | None = None) -> int:
        """Run the statements in one transaction; returns what the query ``count`` finds at its end.

        A transaction that the database rolled back for another one's sake (SQLSTATE class 40) is
        run again.  Reports are replaced concurrently; their statements take turns.
        """
        for attempt in range(RETRIES):
            try:
                with self._turn, self.connection() as conn:
                    return _run(conn, statements, count)
            except Py4JJavaError as error:
                state = getattr(error.java_exception, "getSQLState", lambda: None)()
                if attempt + 1 == RETRIES or not str(state).startswith("40"):
                    raise
        return 0

    def quoted(self, name: str) -> str:
        return self._dialect.quoteIdentifier(name)

    def column_type(self, field: T.StructField, in_key: bool) -> str:
        if in_key and isinstance(field.dataType, T.StringType):
            return KEY_TEXT
        kind = self._jvm.org.apache.spark.sql.types.DataType.fromJson(field.dataType.json())
        own = self._dialect.getJDBCType(kind)
        if own.isDefined():
            return own.get().databaseTypeDefinition()
        return COMMON_TYPES[field.dataType.typeName()]

    def create_sql(self, table: str, schema: T.StructType, keys: Sequence[str],
                   column_types: Mapping[str, str] | None = None) -> str:
        """CREATE TABLE with the columns of ``schema`` and a primary key over ``keys``."""
        missing = set(keys) - set(schema.names)
        if missing:
            raise ValueError(f"{table}: no columns {sorted(missing)}")
        columns = [f"{self.quoted(f.name)} {(column_types or {}).get(f.name) or self.column_type(f, f.name in keys)}"
                   + (" NOT NULL" if f.name in keys else "") for f in schema.fields]
        if keys:
            columns.append(f"PRIMARY KEY ({', '.join(self.quoted(k) for k in keys)})")
        return f"CREATE TABLE {table} ({', '.join(columns)})"

    def has_table(self, table: str) -> bool:
        """Whether the table can be read."""
        try:
            with self.connection() as conn:
                statement = conn.createStatement()
                statement.executeQuery(self._dialect.getTableExistsQuery(table)).close()
                statement.close()
            return True
        except Exception as error:  # noqa: BLE001 - databases differ in what they raise
            if "SQL" not in str(error):
                raise
            return False

    def primary_key(self, table: str) -> list[str]:
        """The columns of the table's declared key, in their order."""
        with self.connection() as conn:
            rows = conn.getMetaData().getPrimaryKeys(None, None, table)
            found = []
            while rows.next():
                found.append((rows.getShort("KEY_SEQ"), rows.getString("COLUMN_NAME")))
            rows.close()
        return [name for _, name in sorted(found)]

    def ensure_table(self, table: str, schema: T.StructType, keys: Sequence[str] = (),
                     column_types: Mapping[str, str] | None = None) -> bool:
        """Create the table unless it exists; returns whether it was created."""
        if self.has_table(table):
            return False
        self.execute(self.create_sql(table, schema, keys, column_types))
        return True

    def replace(self, df: DataFrame, table: str, keys: Sequence[str] = (),
                column_types: Mapping[str, str] | None = None) -> int:
        """Make the rows of ``df`` the table's rows; returns how many there are."""
        self.ensure_table(table, df.schema, keys, column_types)
        staging = f"{table}_{uuid.uuid4().hex[:12]}"
        self.execute(self.create_sql(staging, df.schema, keys, column_types))
        try:
            writer = df.write.mode("append").format("jdbc").option("url", self.url).option("dbtable", staging)
            for key, value in self.properties.items():
                writer = writer.option(key, value)
            writer.save()
            columns = ", ".join(self.quoted(c) for c in df.columns)
            return self.execute(f"DELETE FROM {table}",
                                f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging}",
                                count=f"SELECT COUNT(*) FROM {table}")
        finally:
            self.execute(f"DROP TABLE {staging}")

    def read(self, table: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", table)
        for key, value in self.properties.items():
            reader = reader.option(key, value)
        return reader.load()


def _run(conn, statements: Sequence[str], count: str | None = None) -> int:
    statement = conn.createStatement()
    for sql in statements:
        statement.executeUpdate(sql)
    found = 0
    if count:
        rows = statement.executeQuery(count)
        rows.next()
        found = rows.getLong(1)
    statement.close()
    return found
