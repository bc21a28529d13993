"""No streaming operators: every table is produced by a batch run and recovered by running it again."""
