"""The message formats that the parsers recognise, as regular expressions; (?i) ignores case."""

PREFIX = r"^\s*(\d+):\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?::\d+)?\s*\[([^\]]+)\]"
LINE_START = r"^\s*(\d+):\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?::\d+)?"
SEVERITY = r"\]([EWITD]):"
TIMESTAMP = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})"
ERROR = r"(?i)\][EW]:|SQL_ERROR|SqlState:|NativeError:"
LATENCY = r"Source latency ([0-9.]+) seconds,\s*Target latency ([0-9.]+) seconds,\s*Handling latency ([0-9.]+) seconds"
REDO_READ = r"(?is)Completed to read from archived Redo log.*?(\d+)\s+bytes.*?Read Time:\s*(\d+)\s*ms"
REDO_SOURCE = r"([a-zA-Z0-9_]+\.c:\d+)"
ASM_READ = r"(?i)Preparing read from ASM statement \((\d+)\)"
REDO_OPEN = r"(?i)Going to open Redo Log with original name '([^']+)'"
REDO_THREAD = r"""(?i)thread id ['"](\d+)['"]"""
REDO_CLOSE = r"(?i)Close Redo log '([^']+)'"
ONE_BY_ONE = r"(?i)Applying\s+\S+\s+one-by-one for table\s+(\S+)"
BULK_MAP = r"(?i)bulk_map:\s+seq\s+(\d+):(\d+)\s+(\w+)"
PK_INSERT = r"(?i)same bulk.*INSERT.*same PK|INSERT.*changes PK.*same bulk"
PK_UPDATE = r"(?i)same bulk.*Update.*updated.*same PK|Update.*changes PK.*same bulk"
PK_DELETE = r"(?i)same bulk.*deleted.*same PK|DELETE.*changes PK.*same bulk"
BATCH_START = r"(?i)Going to start applying bulk changes"
RUN_STATEMENT = r"(?i)Going to run (\w+) statement.*from seq (\d+) to seq (\d+)"
FINISHED_APPLYING = r"(?i)Finished applying of (\d+) '([A-Z]+) \(\d+\)' events for table '([^']+)'\.?'([^']+)'"
START_APPLYING = r"(?i)Start applying '([A-Z]+) \((\d+)\)'.*for table '([^']+)'\.?'([^']+)'"
COMPRESS_START = r"(?i)going to compress file '([^']+)' to '([^']+)'"
COMPRESSED = r"(?i)file compressed"
UPLOADED = r"(?i)File ([^\s]+) of size (\d+) was uploaded successfully"
CSV_NAME = r"(?i)(CDC[0-9A-Fa-f]+\.csv)"
TABLE = r"'([^']+)'\.+'([^']+)'"
NO_PK = r"(?i)no PK for table|Apply no Bulk|without.*primary key"
BULK_TIMEOUT = r"(?i)Set Bulk Timeout\s*=\s*(\d+)\s*milliseconds"
BULK_TIMEOUT_MIN = r"(?i)Set Bulk Timeout Min\s*=\s*(\d+)\s*milliseconds"
BULK_FILE_SIZE = r"(?i)Bulk max file size:\s*(\d+)\s*MB,\s*(\d+)\s*KB"
PARALLEL_APPLY = r"(?i)Parallel bulk apply enabled.*maximum.*?(\d+)"
SOURCE_ENDPOINT = r"(?i)Source endpoint '([^']+)' is using provider"
TARGET_ENDPOINT = r"(?i)Target endpoint '([^']+)' is using provider"
MERGE = r"(?i)Going to execute MERGE|Merge table statement MERGE"
MEMORY_WARNING = r"(?i)\[SORTER(?:_STORAGE)?\s*\].*(?:memory|overflow|buffer full|storage limit)"
TARGET_DISCONNECT = r"(?i)\[TARGET_APPLY\s*\].*(?:disconnect|lost connection|connection closed|connection failed)"
SOURCE_RECONNECT = r"(?i)\[SOURCE_CAPTURE\s*\].*(?:reconnect|retry|re-establish|connection restored)"
NETWORK_ERROR = r"(?i)network error|socket error|timeout|connection refused|connection reset"
RESOURCE_LIMIT = r"(?i)memory limit|out of memory|resource limit|thread limit|max connections"
SQL_STATE = r"(?i)SqlState:\s*(\w+)\s+NativeError:\s*(\d+)"
ORA = r"(?i)(ORA-\d{5})"
MYSQL = r"(?i)MySQL.*?Error\s+(\d{4})"
POSTGRES = r"(?i)(?:SQLSTATE|PG)\s*[=:]?\s*(\d{5})"
ODBC = r"(?i)RetCode:\s*(SQL_\w+)"
NATIVE = r"(?i)NativeError:\s*(\d+)"
FULL_LOAD = {
    "init_segmented": (r"(?i)Start initializing segmented table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\s*by subtask\s*(\d+)", ("schema", "table", "table_id", "subtask")),
    "init_table": (r"(?i)Start initializing table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\s*by subtask\s*(\d+)", ("schema", "table", "table_id", "subtask")),
    "start_segment": (r"(?i)Start loading segment #(\d+)\s+of\s+(\d+)\s+of table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\s*by subtask\s*(\d+)", ("seg", "seg_total", "schema", "table", "table_id", "subtask")),
    "start_table": (r"(?i)Start loading table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\s*by subtask\s*(\d+)", ("schema", "table", "table_id", "subtask")),
    "unload_segment": (r"(?i)Unload finished for segment #(\d+)\s+of segmented table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\.\s*(\d+)\s+rows sent", ("seg", "schema", "table", "table_id", "rows")),
    "unload_table": (r"(?i)Unload finished for table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\.\s*(\d+)\s+rows sent", ("schema", "table", "table_id", "rows")),
    "load_segment": (r"(?i)Load finished for segment #(\d+)\s+of segmented table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\.\s*(\d+)\s+rows received\.\s*(\d+)\s+rows skipped\.\s*Volume transferred\s+(\d+)", ("seg", "schema", "table", "table_id", "rows", "skipped", "volume")),
    "load_table": (r"(?i)Load finished for table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\.\s*(\d+)\s+rows received\.\s*(\d+)\s+rows skipped\.\s*Volume transferred\s+(\d+)", ("schema", "table", "table_id", "rows", "skipped", "volume")),
    "task_segment": (r"(?i)Load finished for segment #(\d+)\s+of table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\s*by subtask\s*(\d+)\.\s*(\d+)\s+records transferred", ("seg", "schema", "table", "table_id", "subtask", "rows")),
    "task_table": (r"(?i)Load finished for table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)\s*by subtask\s*(\d+)\.\s*(\d+)\s+records transferred", ("schema", "table", "table_id", "subtask", "rows")),
    "reload": (r"(?i)Reloading table\s+(\d+)\s+because subtask\s*#(\d+)\s+that was loading segment\s+(\d+)\s+finished with error", ("table_id", "subtask", "seg")),
    "where": (r"(?i)Transformation Where\s+'([^']*)'", ("predicate",)),
    "command": (r"(?i)Command 'UNLOAD_TABLE_SEGMENT'\s+received in component 'st_(\d+)_", ("subtask",)),
    "running_mode": (r"(?i)Task\s+'([^']+)'\s+running full load(?:\s+and\s+CDC)?\s+in\s+(.+?)\s+mode", ("task", "mode")),
    "prepared": (r"(?i)Completed target preparation for (?:segmented )?table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)", ("schema", "table", "table_id")),
    "init_finished": (r"(?i)Initialization finished for (?:segmented )?table '([^']+)'\.'([^']+)'\s*\(Id\s*=\s*(\d+)\)", ("schema", "table", "table_id")),
    "completed": (r"(?i)Full\s+[Ll]oad\s+completed", ()),
}
SORTER = {
    "received": r"(?i)\[SORTER\s*\].*received\s+(\d+)\s+(?:events?|changes?|records?)",
    "sent": r"(?i)\[SORTER\s*\].*sent\s+(\d+)\s+(?:events?|changes?|records?).*apply",
    "capture_rate": r"(?i)\[SOURCE_CAPTURE\s*\].*(\d+)\s+(?:events?|changes?|records?)\s*(?:per|/)\s*(?:second|sec)",
    "apply_rate": r"(?i)\[TARGET_APPLY\s*\].*(\d+)\s+(?:events?|changes?|records?)\s*(?:per|/)\s*(?:second|sec)",
    "queue_depth": r"(?i)\[SORTER\s*\].*queue.*(\d+)|pending\s+(\d+)",
    "captured": r"(?i)captured (\d+) (?:events?|changes?)",
    "throughput": r"(?i)(\d+)\s*(?:events?|changes?|records?)\s*(?:per|/)\s*(?:second|sec|s)",
    "log_position": r"(?i)(?:LSN|SCN|position|log seq(?:uence)?)[\s:=]+([0-9A-Fa-f:]+)",
    "transaction": r"(?i)Transaction consistency.*confirmed_record_id = (\d+)",
    "reload": r"(?i)Reload for table Id (\d+) is requested",
    "collecting": r"(?i)Start collecting changes for table id = (\d+)",
    "memory_limit": r"(?i)Stop reading when memory limit reached.*is set to (true|false)",
    "backlog": r"(?i)(sorter.*backlog|pending.*transactions?|waiting.*commit)",
    "slow_read": r"(?i)(\[SOURCE_CAPTURE\s*\].*(?:slow|delay|wait|blocked))",
    "contention": r"(?i)(\[SOURCE_CAPTURE\s*\].*(?:lock|contention|wait|blocked by))",
}
