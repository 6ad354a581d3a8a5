"""Log lines derived from the driver's events table: the same SQL text gives the same lines in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replog.plans.scale import numbered

#: Numbers are rendered from integers, so both engines give the same text; a time is the event's, to the second.
LINES_SQL = r"""
SELECT file_id, line_number, CASE
    WHEN k = 'cont' THEN '  at step ' || CAST(c % 100 AS STRING) || ' of ORA-0' || lpad(CAST(c % 10000 AS STRING), 4, '0')
    ELSE prefix || msg END AS body
FROM (SELECT file_id, line_number, c, k,
    lpad(CAST(thread AS STRING), 8, '0') || ': ' || replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || ' ' AS prefix,
    CASE
    WHEN k = 'perf' THEN '[PERFORMANCE     ]I:  Source latency ' || CAST(CAST(floor(c / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(c % 100 AS STRING), 2, '0') || ' seconds, Target latency '
        || CAST(CASE WHEN day(ts) % 6 = 0 THEN 60 + c % 3 ELSE c % 37 END AS STRING) || '.5 seconds, Handling latency ' || CAST(c % 11 AS STRING) || '.25 seconds'
    WHEN k = 'start' THEN '[TARGET_APPLY    ]T:  Start applying ''' || CASE c % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END || ' (' || CAST(c % 9 + 1 AS STRING) || ')'' changes for table ''dbo''.''t' || CAST(c % 5 AS STRING) || ''''
    WHEN k = 'finish' THEN '[TARGET_APPLY    ]T:  Finished applying of ' || CAST(c % 9 + 1 AS STRING) || ' ''INSERT (3)'' events for table ''dbo''.''t' || CAST(c % 5 AS STRING) || ''''
    WHEN k = 'bulk' THEN '[TARGET_APPLY    ]I:  Going to start applying bulk changes'
    WHEN k = 'run' THEN '[TARGET_APPLY    ]D:  Going to run INSERT statement for table ''dbo''.''t' || CAST(c % 5 AS STRING) || ''' from seq 1 to seq ' || CAST(c % 50 + 1 AS STRING)
    WHEN k = 'end' THEN '[TARGET_APPLY    ]I:  Bulk finished.'
    WHEN k = 'reason' THEN '[TARGET_APPLY    ]I:  Finish bulk because of ' || CASE CASE WHEN file_id % 4 = 1 THEN c % 2 + 1 ELSE c % 4 END WHEN 0 THEN 'memory limit' WHEN 1 THEN 'stream timeout' WHEN 2 THEN 'bulk timeout' ELSE 'resume' END
    WHEN k = 'map' THEN '[TARGET_APPLY    ]T:  bulk_map: seq 1:' || CAST(CASE WHEN file_id % 2 = 0 THEN c % 4 + 1 ELSE c % 40 + 1 END AS STRING) || ' ' || CASE c % 4 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' ELSE 'UNKNOWN' END || ' ''dbo''.''t' || CAST(c % 5 AS STRING) || ''''
    WHEN k = 'open' THEN '[SOURCE_CAPTURE  ]I:  Going to open Redo Log with original name ''/redo/' || CAST(c % 7 AS STRING) || ''''
    WHEN k = 'close' THEN '[SOURCE_CAPTURE  ]I:  Close Redo log ''/redo/' || CAST(c % 7 AS STRING) || ''''
    WHEN k = 'read' THEN '[PERFORMANCE     ]T:  Completed to read from archived Redo log ' || CAST((c % 2 + 1) * 1000 AS STRING) || ' bytes. Read time: ' || CAST(c % 900 AS STRING) || ' ms (oracdc.c:' || CAST(c % 2 + 10 AS STRING) || ')'
    WHEN k = 'sort' THEN '[SORTER          ]W:  Memory limit reached, buffer full, pending ' || CAST(c % 70 AS STRING) || ' events'
    WHEN k = 'state' THEN '[TARGET_APPLY    ]E:  Failed to execute statement. SqlState: HY000 NativeError: ' || CAST(c % 4 + 1200 AS STRING) || ' on t' || CAST(c % 5 AS STRING)
    WHEN k = 'ora' THEN '[SOURCE_CAPTURE  ]E:  ORA-000' || CAST(c % 40 + 50 AS STRING) || ' resource busy, connection timeout'
    WHEN k = 'warn' THEN '[SOURCE_CAPTURE  ]W:  Slow read, going to reconnect. RetCode: SQL_ERROR'
    ELSE '[TASK_MANAGER    ]I:  Checking status of table ' || CAST(c % 13 AS STRING) END AS msg
  FROM (SELECT user_id % 8 AS file_id, ts, user_id AS thread, CAST(floor(value * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS line_number,
      CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 8 = 0 THEN 'read' ELSE 'perf' END
        WHEN event_type = 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'bulk' WHEN 1 THEN 'start' WHEN 2 THEN 'open' WHEN 3 THEN 'bulk' ELSE 'start' END
        WHEN event_type = 'purchase' THEN CASE event_id % 6 WHEN 0 THEN 'run' WHEN 1 THEN 'end' WHEN 2 THEN 'finish' WHEN 3 THEN 'run' WHEN 4 THEN 'close' ELSE 'map' END
        WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'state' WHEN 1 THEN 'ora' WHEN 2 THEN 'warn' ELSE 'sort' END
        ELSE CASE event_id % 4 WHEN 0 THEN 'cont' WHEN 1 THEN 'reason' ELSE 'info' END END AS k
    FROM {events}) AS a) AS b
"""


#: Ids of a split: no key has more rows in one.
SPLIT = 1 << 16


def _placed(sql: str, file: str, order: str) -> str:
    """The SQL over rows that have file_id, split and line_number already, so that no task numbers a whole file."""
    number = f"row_number() OVER (PARTITION BY {file} ORDER BY {order}) - 1 AS line_number"
    for old, new in ((f"{file} AS file_id", "file_id"), (number, "line_number, split"), ("SELECT file_id, line_number, c", "SELECT file_id, line_number, split, c"), ("SELECT file_id, line_number, CASE", "SELECT file_id, line_number, split, CASE"), ("SELECT file_id, line_number, lpad", "SELECT file_id, line_number, split, lpad")):
        sql = sql.replace(old, new)
    return sql


def _rows(spark: SparkSession, path: str, file: str, order: str) -> DataFrame:
    own = spark.read.parquet(path)
    # parts grow with the rows, so that what a task sorts does not; rows are counted from the files' footers
    parts = max(spark.sparkContext.defaultParallelism, 1 + own.count() // SPLIT)
    own = own.withColumns({"file_id": F.expr(file), "split": F.floor(F.col(order) / SPLIT)}).repartition(parts, "file_id", "split")
    return numbered(own, ["file_id"], order, "line_number", "split")


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, line_number, split (it grows with the lines of a file) and body of every line: the rows of LINES_SQL, numbered over splits."""
    file, order = "user_id % 8", "event_id"
    return spark.sql(_placed(LINES_SQL, file, order), events=_rows(spark, f"{sf_dir}/events.parquet", file, order))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, line_number and body of every line."""
    return placed_lines(spark, sf_dir).drop("split")


#: Load, upload and apply-mode lines derived from the orders table.
LOAD_SQL = r"""
SELECT file_id, line_number, lpad(CAST(sub AS STRING), 8, '0') || ': 2025-01-' || lpad(CAST(1 + CAST(floor(line_number / 86400) AS BIGINT) % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(CAST(floor(line_number / 3600) AS BIGINT) % 24 AS STRING), 2, '0') || ':' || lpad(CAST(CAST(floor(line_number / 60) AS BIGINT) % 60 AS STRING), 2, '0')
    || ':' || lpad(CAST(line_number % 60 AS STRING), 2, '0') || ' ' || CASE k
    WHEN 0 THEN '[TASK_MANAGER    ]I:  Start loading segment #' || seg || ' of 4 of table ''dbo''.''t' || tab || ''' (Id = ' || tab || ') by subtask ' || CAST(sub AS STRING)
    WHEN 1 THEN '[SOURCE_UNLOAD   ]I:  Unload finished for segment #' || seg || ' of segmented table ''dbo''.''t' || tab || ''' (Id = ' || tab || '). ' || CAST(n AS STRING) || ' rows sent.'
    WHEN 2 THEN '[TARGET_LOAD     ]I:  Load finished for segment #' || seg || ' of segmented table ''dbo''.''t' || tab || ''' (Id = ' || tab || '). ' || CAST(n AS STRING) || ' rows received. 0 rows skipped. Volume transferred ' || CAST(n * 8 AS STRING) || '.'
    WHEN 3 THEN CASE WHEN n % 9 = 0 THEN '[TASK_MANAGER    ]W:  Reloading table ' || tab || ' because subtask #' || CAST(sub AS STRING) || ' that was loading segment ' || seg || ' finished with error' WHEN n % 9 = 1 THEN '[SERVER          ]I:  Log level of component ''SORTER'' was changed from ''INFO'' to ''DEBUG'''
        WHEN n % 9 = 2 THEN '[TARGET_LOAD     ]I:  ODBC driver: Native Client ' || CAST(n % 4 AS STRING) WHEN n % 9 = 3 THEN '[SERVER          ]I:  Licensed to Acme Works, all rights'
        WHEN n % 9 = 4 THEN '[TASK_MANAGER    ]I:  Task initialization completed' WHEN n % 9 = 5 THEN '[SORTER          ]I:  Start processing changes' ELSE '[TASK_MANAGER    ]I:  Loading goes on' END
    WHEN 4 THEN '[FILE_FACTORY    ]T:  Going to compress file ''C:\out\CDC0' || tab || '.csv'' to ''C:\out\CDC0' || tab || '.csv.gz'''
    WHEN 5 THEN '[FILE_FACTORY    ]T:  file compressed'
    WHEN 6 THEN '[FILE_FACTORY    ]I:  File C:\out\CDC0' || tab || '.csv.gz of size ' || CAST(n * CASE WHEN file_id % 2 = 0 THEN 10 ELSE 100 END AS STRING) || ' was uploaded successfully'
    WHEN 7 THEN '[TARGET_APPLY    ]I:  Applying INSERT one-by-one for table ''dbo''.''t' || tab || ''''
    WHEN 8 THEN '[TARGET_APPLY    ]E:  Failed to execute statement. NativeError: ' || CAST(n % 5 AS STRING)
    WHEN 9 THEN '[TARGET_APPLY    ]I:  Switch back to bulk apply mode'
    WHEN 10 THEN '[TARGET_APPLY    ]W:  There is no PK for table id ' || tab
    WHEN 11 THEN '[SOURCE_CAPTURE  ]T:  Preparing read from ASM statement (' || CAST(n % 3 AS STRING) || ')'
    WHEN 12 THEN '[TARGET_APPLY    ]D:  Going to run UPDATE statement from seq 1 to seq ' || CAST(n % 20 + 1 AS STRING)
    WHEN 13 THEN '[SORTER          ]I:  captured ' || CAST(n AS STRING) || ' events'
    WHEN 14 THEN '[SOURCE_UNLOAD   ]T:  Command ''UNLOAD_TABLE_SEGMENT'' received in component ''st_' || CAST(sub AS STRING) || '_x'''
    ELSE '[SOURCE_UNLOAD   ]T:  Transformation Where ''id < ' || CAST(n AS STRING) || '''' END AS body
FROM (SELECT o_custkey % 4 AS file_id, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderkey) - 1 AS line_number, CAST(o_orderkey % 7 AS STRING) AS tab, CAST(o_custkey % 4 + 1 AS STRING) AS seg, o_custkey % 6 AS sub, o_orderkey % 1000 AS n,
      CAST(floor(o_orderkey / 2) AS BIGINT) % 16 AS k FROM {orders}) AS a
"""


def placed_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """load_lines with their split."""
    file, order = "o_custkey % 4", "o_orderkey"
    return spark.sql(_placed(LOAD_SQL, file, order), orders=_rows(spark, f"{sf_dir}/orders.parquet", file, order))


def load_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, line_number and body of load, upload and apply-mode lines."""
    return placed_loads(spark, sf_dir).drop("split")
