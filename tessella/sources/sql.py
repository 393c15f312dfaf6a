"""Datasets that a read-only SQL query gives: SQLite by a Spark data source, PostgreSQL by JDBC.

Connections are named in specifications and resolved from the environment, so that neither specifications
nor evidence hold credentials.
"""

from __future__ import annotations

import os
import re
import sqlite3
import time
from collections.abc import Iterator, Mapping
from decimal import Decimal
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DataError, SpecError
from ..functions.hashing import digest

DEFAULTS = {"max_rows": 1_000_000, "timeout_seconds": 60, "chunk_size": 10_000}
KNOWN = {"connection", "query", "params", *DEFAULTS}


def environment_name(reference: str) -> str:
    """SRC10: the variable that holds a connection's URL."""
    return "TESSELLA_CONNECTION_" + re.sub(r"[^A-Za-z0-9]+", "_", reference).strip("_").upper()


def check_config(config: object, at: str) -> None:
    """SRC9: raises SpecError unless the block is well formed and its query reads."""
    if not isinstance(config, Mapping):
        raise SpecError(f"{at} must be a mapping")
    if extra := set(config) - KNOWN:
        raise SpecError(f"{at}: unknown {', '.join(sorted(map(str, extra)))}")
    for name in ("connection", "query"):
        if not isinstance(config.get(name), str) or not config[name].strip():
            raise SpecError(f"{at}.{name} must be text")
    bare = re.sub(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*", "", config["query"], flags=re.S)
    if not re.match(r"(?:select|with)\b", bare, re.I):
        raise SpecError(f"{at}.query must start with SELECT or WITH")
    if not isinstance(config.get("params", {}), Mapping):
        raise SpecError(f"{at}.params must be a mapping")
    for name in DEFAULTS:
        v = config.get(name, 1)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v <= 0 or name != "timeout_seconds" and not isinstance(v, int):
            raise SpecError(f"{at}.{name} must be a positive number")


def connection(reference: str) -> tuple[str, str]:
    """Dialect and URL of a connection."""
    name = environment_name(reference)
    url = os.environ.get(name)
    if not url:
        raise DataError(f"connection {reference!r}: set {name}")
    scheme = urlsplit(url).scheme.split("+")[0]
    dialect = {"sqlite": "sqlite", "postgresql": "postgresql", "postgres": "postgresql"}.get(scheme)
    if dialect is None:
        raise DataError(f"connection {reference!r}: {scheme or 'no'} dialect; known are sqlite and postgresql")
    return dialect, url


def opened(path: str, seconds: float) -> sqlite3.Connection:
    """SRC8: a SQLite connection that can't write and stops after ``seconds``."""
    try:
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    except sqlite3.Error as e:
        raise DataError(f"the database can't be opened: {e}") from None
    db.execute("PRAGMA query_only = ON")
    over = time.monotonic() + seconds
    db.set_progress_handler(lambda: time.monotonic() > over, 10_000)
    return db


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], params: Mapping[str, str]) -> None:
        self.path, self.query, self.params = options["path"], options["query"], dict(params)
        self.seconds, self.rows, self.chunk = float(options["timeout_seconds"]), int(options["max_rows"]), int(options["chunk_size"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        db = opened(self.path, self.seconds)
        try:
            cursor, n = db.execute(self.query, self.params), 0
            while part := cursor.fetchmany(self.chunk):
                n += len(part)
                if n > self.rows:
                    raise DataError(f"the query gives more than max_rows = {self.rows} rows")
                yield from (tuple(None if v is None else v.decode() if isinstance(v, bytes) else str(v) for v in row) for row in part)
        except sqlite3.OperationalError as e:
            raise DataError(f"the query took more than {self.seconds:g} s" if "interrupted" in str(e) else f"the query failed: {e}") from None
        finally:
            db.close()


class SqliteSource(DataSource):
    """SRC7: ``spark.read.format("tessella_sqlite")``."""

    @classmethod
    def name(cls) -> str:
        return "tessella_sqlite"

    def _params(self) -> dict[str, str]:
        return {k.removeprefix("param."): v for k, v in self.options.items() if k.startswith("param.")}

    def schema(self) -> str:
        db = opened(self.options["path"], float(self.options["timeout_seconds"]))
        try:
            cursor = db.execute(f"SELECT * FROM ({self.options['query'].rstrip().rstrip(';')}) LIMIT 0", self._params())
            names = [d[0] for d in cursor.description]
        except sqlite3.Error as e:
            raise DataError(f"the query failed: {e}") from None
        finally:
            db.close()
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options), self._params())


#: What a parameter's name is not looked for in: text, quoted names, comments, casts.
_APART = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$|::"


def literal(value: object) -> str:
    """A value as PostgreSQL writes it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return f"({value})" if str(value)[0] in "-0123456789" and "n" not in str(value) else f"'{value}'::numeric"
    if "\0" in str(value):
        raise DataError("a bound text can't hold a zero byte")
    quoted = str(value).replace("'", "''")
    return f"E'{quoted.replace(chr(92), chr(92) * 2)}'" if "\\" in quoted else f"'{quoted}'"


def bound(query: str, params: Mapping[str, object]) -> str:
    """``query`` with a literal for each ``:name`` that stands outside of text, names and comments."""

    def one(m: re.Match) -> str:
        if not m["name"]:
            return m[0]
        if m["name"] not in params:
            raise DataError(f"the query asks for {m['name']!r}, which params lack")
        return literal(params[m["name"]])

    return re.sub(rf"{_APART}|:(?P<name>[A-Za-z_]\w*)", one, query, flags=re.S)


def postgres_options(url: str, query: str, settings: Mapping) -> dict[str, str]:
    """What the JDBC reader needs: a session that can only read and stops its statements in time."""
    parts, seconds = urlsplit(url), float(settings["timeout_seconds"])
    return {
        "url": f"jdbc:postgresql://{parts.hostname}:{parts.port or 5432}{parts.path}",
        "user": unquote(parts.username or ""),
        "password": unquote(parts.password or ""),
        "driver": "org.postgresql.Driver",
        "query": query,
        "fetchsize": str(settings["chunk_size"]),
        "queryTimeout": str(max(1, int(seconds))),
        "sessionInitStatement": f"SET default_transaction_read_only = on; SET statement_timeout = {max(1, int(seconds * 1000))}",
    }


def read_sql(spark: SparkSession, config: Mapping) -> DataFrame:
    """The rows of a SQL endpoint as they were at one moment: read once and kept for all checks (SRC11)."""
    dialect, url = connection(config["connection"])
    settings = DEFAULTS | {k: config[k] for k in DEFAULTS if k in config}
    query = config["query"].strip().rstrip(";")
    if dialect == "sqlite":
        spark.dataSource.register(SqliteSource)
        reader = spark.read.format(SqliteSource.name()).options(path=re.sub(r"\Asqlite(?:\+\w+)?:/{0,3}(?=/|[^/])", "", url), query=query, **{k: str(v) for k, v in settings.items()})
        for k, v in (config.get("params") or {}).items():
            reader = reader.option(f"param.{k}", str(v))
        return reader.load()
    try:
        frame = spark.read.format("jdbc").options(**postgres_options(url, bound(query, config.get("params") or {}), settings)).load()
        # The rows are kept as they are counted, so that the guard and all checks see one execution.
        frame = frame.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns]).limit(settings["max_rows"] + 1).persist()
        rows = frame.count()
    except DataError:
        raise
    except Exception as e:
        raise DataError(f"PostgreSQL can't be read: {str(e).splitlines()[0]}") from None
    if rows > settings["max_rows"]:
        frame.unpersist()
        raise DataError(f"the query gives more than max_rows = {settings['max_rows']} rows")
    return frame


def provenance(config: Mapping) -> dict:
    """What evidence may say about a SQL input: never a URL."""
    return {"kind": "sql", "connection": config["connection"], "dialect": connection(config["connection"])[0], "query_sha256": digest(config["query"]), "parameters": sorted(config.get("params") or {})}
