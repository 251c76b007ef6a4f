"""A guarded SQL tool over registered frames: one statement, capped rows, errors as text."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-z_][a-z0-9_]*\Z")
_READS = re.compile(r"\s*(select|with|values|show|describe|desc|explain)\b", re.IGNORECASE)
#: Classes of parsed nodes that do more than read.
_CHANGES = re.compile(r"Command|Create|Insert|Drop|Delete|Update|Merge|Replace|Alter|Truncate|Load|Refresh|Cache|Set[A-Z]|Rename|Add[A-Z]|Overwrite|Append|Analyze|Repair|Uncache|UseCatalog|SetCatalog|CompoundBody")
#: A quoted text or name, a comment, or a semicolon.
_PIECE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.DOTALL)
_REFUSED = re.compile(r"\b(attach|copy|add\s+jar|set\s+role|load\s+data)\b", re.IGNORECASE)


def register(frames: Mapping[str, DataFrame]) -> None:
    """Each frame as a temporary view; names are lower-case identifiers."""
    for name, df in frames.items():
        if not _NAME.match(name):
            raise ValueError(f"not a table name: {name!r}")
        df.createOrReplaceTempView(name)


def capped(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first `most` rows in order, and whether there are more."""
    first = df.orderBy(*order).limit(most + 1).withColumn("__n", F.lit(1))
    size = first.agg((F.sum("__n") > most).alias("more"))
    return first.drop("__n").orderBy(*order).limit(most).join(F.broadcast(size))


def statement(sql: str) -> str:
    """The one statement of a text; several, or refused ones, are errors. Semicolons in quotes and comments do not count."""
    parts, last = [], 0
    for m in _PIECE.finditer(sql):
        if m.group() == ";":
            parts.append(sql[last : m.start()])
            last = m.end()
    parts = [p.strip() for p in [*parts, sql[last:]] if _PIECE.sub(lambda m: m.group() if m.group()[0] in "'\"`" else " ", p).strip(" \t\r\n;")]
    if len(parts) != 1:
        raise ValueError("one statement at a time")
    if _REFUSED.search(parts[0]):
        raise ValueError("statement refused")
    return parts[0]


def text_table(df: DataFrame, most_rows: int = 200, most_chars: int = 6000) -> str:
    """Rows as text, at most so many rows and characters; says where it was cut."""
    rows = df.limit(most_rows + 1).collect()
    lines = [" | ".join(df.columns)] + [" | ".join("NULL" if v is None else str(v) for v in r) for r in rows[:most_rows]]
    if len(rows) > most_rows:
        lines.append(f"... more than {most_rows} rows")
    out = "\n".join(lines)
    return out if len(out) <= most_chars else out[:most_chars] + "\n... cut"


def run_sql(spark: SparkSession, sql: str, most_rows: int = 200) -> str:
    """Result of a query as text, OK for other statements, the message of an error."""
    try:
        one = statement(sql)
        df = spark.sql(one)
        return text_table(df, most_rows) if _READS.match(one) else "OK"
    except (PySparkException, ValueError) as e:
        return f"ERROR: {str(e).splitlines()[0]}"


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a query, and of nothing else: Spark's own parser must take the text for a plan without a command.

    Statements that create, drop, insert, set or add are commands or nodes that change something to the parser, with
    or without a WITH clause before them, and raise; so does a text that does not parse.
    """
    one = statement(sql)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(one)
    todo = [plan]
    while todo:
        node = todo.pop()
        if _CHANGES.search(node.getClass().getName()):
            raise ValueError(f"not a query: {node.nodeName()}")
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return spark.sql(one)


def read_only_rows(spark: SparkSession, sql: str, seconds: float = 30, most_rows: int = 200) -> dict:
    """ok, rows, more of a query, or ok False and error; a query that takes longer than `seconds` is cancelled."""
    sc, tag = spark.sparkContext, f"read-only-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, lambda: sc.cancelJobsWithTag(tag))
    try:
        df = read_only(spark, sql)
        sc.addJobTag(tag)
        timer.start()
        rows = df.limit(most_rows + 1).collect()
        return {"ok": True, "rows": [tuple(r) for r in rows[:most_rows]], "more": len(rows) > most_rows}
    except (PySparkException, ValueError, Py4JJavaError) as e:
        return {"ok": False, "error": f"{type(e).__name__}: {str(e).splitlines()[0]}"[:300]}
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


class Engine:
    """The five verbs of an engine under test: available, setup, load, scalar, teardown."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def available(self) -> bool:
        return not self.spark.sparkContext._jsc.sc().isStopped()

    def setup(self) -> None:
        self.names = []

    def load(self, name: str, df: DataFrame) -> None:
        register({name: df})
        self.names.append(name)

    def scalar(self, sql: str):
        """The single value of a query, floats to six places."""
        rows = self.spark.sql(statement(sql)).limit(2).collect()
        if len(rows) != 1 or len(rows[0]) != 1:
            raise ValueError("not a single value")
        value = rows[0][0]
        return round(float(value), 6) if value is not None and type(value).__name__ in ("float", "Decimal") else value

    def teardown(self) -> None:
        for name in self.names:
            self.spark.catalog.dropTempView(name)
        self.names = []
