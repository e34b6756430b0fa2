"""Running a user's query: reading statements only, a cap on the rows shown, a budget of time."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from oxbow.plans.reader import QueryError

#: First words of statements that read, rows shown by default, seconds a query may take.
READS = ("select", "show", "explain", "with")
ROWS, SECONDS = 200, 300.0
#: Plans that change something begin with one of these.
WRITES = re.compile(r"(Insert|Append|Overwrite|Create|Replace|Drop|Delete|Update|Merge|Alter|Truncate|Load|Set|Reset|Cache|Uncache|Refresh|Add|Save|Repair|Recover|Analyze|Rename|Call|Use|Write|Clear)")


@dataclass(frozen=True)
class Page:
    columns: list[str]
    rows: list[Row]
    truncated: bool


def checked(text: str) -> str:
    """The statement, if it reads."""
    words = text.split(None, 1)
    if not words or words[0].lower() not in READS:
        raise QueryError(f"a statement begins with one of: {', '.join(READS)}")
    return text


def checked_plan(spark: SparkSession, text: str) -> str:
    """The statement, if all of its parsed plan reads: a write behind WITH or EXPLAIN is found too."""
    checked(text)
    waiting = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]
    while waiting:
        plan = waiting.pop()
        name = plan.getClass().getSimpleName()
        if WRITES.match(name):
            raise QueryError(f"the statement writes ({name})")
        if name == "ExplainCommand":
            waiting.append(plan.logicalPlan())
        for parts in (plan.children(), plan.innerChildren()):
            waiting += [x for x in (parts.apply(i) for i in range(parts.size())) if hasattr(x, "innerChildren")]
    return text


def shown(df: DataFrame, n: int = ROWS, seconds: float = SECONDS) -> Page:
    """The first `n` rows and whether there are more; the jobs are cancelled after `seconds`."""
    context, group = df.sparkSession.sparkContext, f"oxbow-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a query within its budget", True)
    timer.start()
    try:
        rows = df.limit(n + 1).collect()
    except Exception as error:
        if over.is_set():
            raise QueryError(f"the query took more than {seconds:g} s") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    return Page(df.columns, rows[:n], len(rows) > n)


def run_sql(spark: SparkSession, text: str, n: int = ROWS, seconds: float = SECONDS) -> Page:
    return shown(spark.sql(checked_plan(spark, text)), n, seconds)
