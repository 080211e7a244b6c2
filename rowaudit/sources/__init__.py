"""Readers and writers: CSV (with encoding fallback), JSON records/lines,
clean-row export, detector persistence."""

from rowaudit.sources.files import (  # noqa: F401
    read_csv, read_json_records, read_jsonl, write_clean_csv,
)
