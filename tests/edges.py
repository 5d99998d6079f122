"""Data folders with empty tables, and with tables whose rows are null in all columns but some."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq


def empty_folder(source, target):
    for path in glob.glob(f"{source}/*.parquet"):
        pq.write_table(pq.read_table(path).slice(0, 0), os.path.join(target, os.path.basename(path)))
    return str(target)


def null_folder(source, target, rows=30):
    """Some real rows, the same rows with every column but the first null, one row of nulls, and each row repeated."""
    for path in glob.glob(f"{source}/*.parquet"):
        table = pq.read_table(path)
        head = table.slice(0, rows)
        blank = pa.table([head.column(0), *[pa.nulls(len(head), f.type) for f in list(table.schema)[1:]]], schema=table.schema)
        nulls = pa.table([pa.nulls(1, f.type) for f in table.schema], schema=table.schema)
        pq.write_table(pa.concat_tables([head, blank, nulls, head]), os.path.join(target, os.path.basename(path)))
    return str(target)
