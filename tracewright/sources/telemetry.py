"""Telemetry tables derived from the driver's tables, by one portable projection each.

The SQL text below runs unchanged in Spark and in DuckDB, so that an oracle starts from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

EVENTS = """SELECT event_id, ts, concat('s', cast(user_id AS string)) AS session_id,
  concat('/w/p', cast(user_id % 7 AS string)) AS workspace_path,
  CASE event_type WHEN 'click' THEN 'code_change' WHEN 'view' THEN 'file_open'
    WHEN 'error' THEN 'terminal_command' WHEN 'purchase' THEN 'prompt' ELSE 'entry_created' END AS type,
  concat('src/m', cast(k % 10 AS string), '/f', cast(k AS string),
    CASE k % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.md' ELSE '.json' END) AS file_path,
  cast(floor(value) AS bigint) % 80 AS lines_added, k % 40 AS lines_removed, k
FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM {events}) e"""

PROMPTS = """SELECT ev.event_id AS prompt_id, ev.ts, ev.session_id, ev.workspace_path, ev.k, d.text,
  CASE WHEN ev.event_id % 5 = 0 THEN ev.event_id + 2 END AS linked_entry_id,
  concat('src/m', cast(ev.k % 10 AS string), '/f', cast(ev.k AS string), '.py') AS context_a,
  concat('src/m', cast((ev.k + 3) % 10 AS string), '/f', cast((ev.k + 3) % 100 AS string), '.js') AS context_b,
  cast(ev.lines_added AS double) AS context_usage, ev.event_id % 4 AS mode_id
FROM ({ev}) ev JOIN {documents} d ON d.doc_id = ev.event_id % 200 WHERE ev.type = 'prompt'"""

ENTRIES = """SELECT ev.event_id AS entry_id, ev.ts, ev.session_id, ev.workspace_path, ev.file_path, ev.type, ev.k,
  CASE WHEN ev.event_id % 3 = 0 THEN ev.event_id - 1 END AS prompt_id, ev.lines_added, ev.lines_removed,
  CASE WHEN ev.k % 11 = 0 THEN NULL ELSE substr(d.text, 1, cast(ev.k * 3 AS int)) END AS before_code,
  substr(d.text, 1, cast(ev.k * 3 + ev.lines_added - 10 AS int)) AS after_code
FROM ({ev}) ev JOIN {documents} d ON d.doc_id = ev.event_id % 200 WHERE ev.type IN ('code_change', 'entry_created')"""

TERMINAL = """SELECT ev.event_id AS command_id, ev.ts, ev.session_id, ev.workspace_path,
  concat(CASE ev.k % 4 WHEN 0 THEN 'git commit' WHEN 1 THEN 'npm test' WHEN 2 THEN 'python' ELSE 'cat' END, ' ', ev.file_path) AS command,
  CASE WHEN ev.k % 2 = 0 THEN 'zsh' ELSE 'bash' END AS source, CASE WHEN ev.k % 7 = 0 THEN NULL ELSE ev.k % 3 END AS exit_code
FROM ({ev}) ev WHERE ev.type = 'terminal_command'"""


def oracle(sql: str) -> str:
    """SQL for DuckDB: the names ev, prompts, entries and terminal stand for the derived tables."""
    ev = EVENTS.replace("{events}", "events")
    parts = [f"ev AS ({ev})"]
    for name, text in (("prompts", PROMPTS), ("entries", ENTRIES), ("terminal", TERMINAL)):
        if f" {name}" in sql or f"({name}" in sql:
            parts.append(f"{name} AS ({text.replace('({ev})', 'ev').replace('{documents}', 'documents')})")
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    body = sql.strip().removeprefix("RECURSIVE").strip()
    return head + ",\n".join(parts) + (",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body)


def spread(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """df over all cores, where its input (or the source that it has most rows of) is so small that a scan or a join would
    keep only some of them busy with what follows."""
    source = df if source is None else source
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (128 << 20) and len(source.inputFiles()) < cores else df


class Tables:
    """The derived tables and the driver's own, read lazily; only the columns that a query uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.spark.sql(EVENTS, events=self.raw("events"))

    def _joined(self, text: str) -> DataFrame:
        return self.spark.sql(text.replace("({ev})", "{ev}"), ev=self.ev, documents=self.raw("documents"))

    @cached_property
    def prompts(self) -> DataFrame:
        return self._joined(PROMPTS)

    @cached_property
    def said(self) -> DataFrame:
        """prompt_id and text of prompts, over all cores: for functions that take long for a text."""
        return spread(self.prompts.select("prompt_id", "text"), self.ev)

    @cached_property
    def entries(self) -> DataFrame:
        return self._joined(ENTRIES)

    @cached_property
    def terminal(self) -> DataFrame:
        return self.spark.sql(TERMINAL.replace("({ev})", "{ev}"), ev=self.ev)
