from tidemark.sources.tables import drop_stored, read_table, shared_dir, stored  # noqa: F401
