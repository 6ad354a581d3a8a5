"""replog: DataFrame operators for data-replication task logs and text corpora."""
