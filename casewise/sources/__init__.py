"""Readers and writers."""

from casewise.sources.tables import (  # noqa: F401
    load_model,
    normalize_columns,
    read_csv,
    read_parquet,
    read_query,
    read_range,
    rows_to_frame,
    save_model,
    write_csv,
    write_parquet,
)
