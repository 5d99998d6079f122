"""Nested records as an adjacency table of nodes, and entity tables made of it.

``shred`` turns each record (JSON text) into rows (record, node, parent, label,
ordinal, kind, scalar): one row for every object, array and scalar, each with
the name it has in its parent and its position there. ``pivot_entities`` joins
object nodes with their scalar children and pivots the labels asked for into
columns: the flat table of one kind of object, with its parent link.

Node names are paths of ordinals (``/2/1/3``), so a node's ancestors are
prefixes of its name and no recursive join is needed to find them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of nodes, about, that an Arrow batch holds at most.
BATCH_BYTES = 32 << 20
#: What may stand around a JSON text.
BLANKS = "\ufeff \t\r\n"

#: Output of ``shred`` beside the record's key columns.
NODE_FIELDS = (
    ("node", pa.string(), T.StringType()),
    ("parent", pa.string(), T.StringType()),
    ("label", pa.string(), T.StringType()),
    ("ordinal", pa.int64(), T.LongType()),
    ("trail", pa.string(), T.StringType()),
    ("place", pa.string(), T.StringType()),
    ("kind", pa.string(), T.StringType()),
    ("scalar", pa.string(), T.StringType()),
)


_SPACE = re.compile(r"[ \t\r\n]*")
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def _read_deep(text: str) -> object:
    """``json.loads`` without recursion, for texts nested beyond its reach."""
    holders: list[tuple[object, str | None]] = []
    at, key = 0, None
    while True:
        at = _SPACE.match(text, at).end()
        sign = text[at : at + 1]
        if sign in ("{", "["):
            value: object = {} if sign == "{" else []
            inner = _SPACE.match(text, at + 1).end()
            if text[inner : inner + 1] == ("}" if sign == "{" else "]"):
                at = inner + 1
            else:
                holders.append((value, key))
                key, at = _member(text, inner) if sign == "{" else (None, inner)
                continue
        elif sign == '"':
            value, at = scanstring(text, at + 1)
        else:
            atom = _ATOM.match(text, at)
            if not atom:
                raise ValueError(f"no value at {at}")
            value, at = json.loads(atom[0]), atom.end()
        while holders:
            holder, above = holders[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            at = _SPACE.match(text, at).end()
            sign, at = text[at : at + 1], at + 1
            if sign == ",":
                key, at = _member(text, at) if isinstance(holder, dict) else (None, at)
                break
            if sign != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"no end of a member at {at}")
            value, key = holder, above
            holders.pop()
        else:
            if _SPACE.match(text, at).end() != len(text):
                raise ValueError(f"more text at {at}")
            return value


def _member(text: str, at: int) -> tuple[str, int]:
    """The name of a member and where its value starts."""
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return name, at + 1


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text)


def write_json(value: object) -> str:
    """A value as JSON text, at any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    stack: list[object] = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, _Raw):
            out.append(item)
        elif isinstance(item, dict):
            parts = [part for i, (k, v) in enumerate(item.items()) for part in (_Raw((", " if i else "{") + json.dumps(k, ensure_ascii=False) + ": "), v)]
            stack.extend(reversed([*(parts or [_Raw("{")]), _Raw("}")]))
        elif isinstance(item, list):
            parts = [part for i, v in enumerate(item) for part in (_Raw(", " if i else "["), v)]
            stack.extend(reversed([*(parts or [_Raw("[")]), _Raw("]")]))
        else:
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)


class _Raw(str):
    """Text that is written as it is."""


def read_json(text: str | None) -> object:
    """The value of a JSON text, at any depth; a text that holds a JSON text is read again, as often as it takes.

    Byte order marks and blanks around the text are ignored. What cannot be read
    is None, like a null.
    """
    value: object = text
    while isinstance(value, str):
        try:
            value = _loads(value.strip(BLANKS))
        except ValueError:
            return None
    return value


def _scalar(value: object) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, (int, float)):
        return "number", repr(value)
    return "string", str(value)


def as_members(value: object, own: frozenset[str]) -> object:
    """A collection in whatever shape it was written, as a list.

    A list stays. An object with a member named in ``own`` is the only element;
    any other object maps identifiers to elements, in the order as written, and
    an element without "id" gets its identifier as such.
    """
    if not isinstance(value, dict):
        return value
    if own & value.keys() or not all(v is None or isinstance(v, dict) for v in value.values()):
        return [value]
    return [v if v is None else {"id": k} | v for k, v in value.items()]


def walk(value: object, embedded: frozenset[str] = frozenset(), collections: dict[str, frozenset[str]] | None = None) -> Iterator[tuple]:
    """The nodes of ``value`` in document order, without recursion.

    ``embedded`` names members whose strings may be JSON text themselves; they
    are read and walked like the rest. ``collections`` names members that are
    brought to a list by ``as_members``. ``trail`` is the chain of labels from
    the root, ``[]`` for an element of an array; ``place`` holds the positions
    of those elements alone. Elements of an array have the label of their array.
    """
    lists = collections or {}
    stack: list[tuple[object, str, str | None, str, int, str, str]] = [(value, "", None, "", 0, "", "")]
    while stack:
        item, node, parent, label, ordinal, trail, place = stack.pop()
        element = trail.endswith("[]")
        if isinstance(item, str) and label in embedded and item.lstrip(BLANKS)[:1] in ("{", "[", '"'):
            inner = read_json(item)
            item = inner if isinstance(inner, (dict, list)) else item
        if label in lists and not element:
            item = as_members(item, lists[label])
        if isinstance(item, dict):
            yield node, parent, label, ordinal, trail, place, "object", None
            stack.extend(reversed([(v, f"{node}/{i}", node, k, i, f"{trail}.{k}", place) for i, (k, v) in enumerate(item.items(), 1)]))
        elif isinstance(item, list):
            yield node, parent, label, ordinal, trail, place, "array", None
            dot = place and place + "."
            stack.extend(reversed([(v, f"{node}/{i}", node, label, i, f"{trail}[]", f"{dot}{i}") for i, v in enumerate(item, 1)]))
        else:
            yield node, parent, label, ordinal, trail, place, *_scalar(item)


def shred(
    df: DataFrame,
    keys: list[str],
    text: str,
    embedded: Iterable[str] = (),
    collections: dict[str, Iterable[str]] | None = None,
    labels: Iterable[str] | None = None,
    objects: str | None = None,
    rows_per_batch: int = 20_000,
) -> DataFrame:
    """The adjacency table of the JSON texts in column ``text``.

    keys: columns that name the record; they are repeated on each node.
    labels: scalar nodes are kept only under these labels (None: all).
    objects: a pattern of the whole trail of the objects that are kept, with their
    scalars; arrays and other nodes are not (None: all nodes are).

    A null or unreadable text gives no rows; ``unreadable`` tells which texts those
    are. A record of any size and depth is emitted in batches, so its nodes never
    have to fit one Arrow batch.
    """
    inline = frozenset(embedded)
    lists = {k: frozenset(v) for k, v in (collections or {}).items()}
    wanted = None if labels is None else frozenset(labels)
    shape = None if objects is None else re.compile(objects)
    source = df.select(*keys, F.col(text).alias("__text"))
    schema = T.StructType([*[source.schema[k] for k in keys], *[T.StructField(n, t) for n, _, t in NODE_FIELDS]])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width)
            at: list[int] = []
            out: list[tuple] = []
            held = 0

            def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                taken = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(width)]
                columns = zip(*out, strict=True)
                made = [pa.array(c, kind) for c, (_, kind, _) in zip(columns, NODE_FIELDS, strict=True)]
                return pa.RecordBatch.from_arrays([*taken, *made], names=[*batch.schema.names[:width], *(n for n, _, _ in NODE_FIELDS)])

            for i, value in enumerate(texts):
                tree = read_json(value.as_py())
                if not isinstance(tree, (dict, list)):
                    continue
                for row in walk(tree, inline, lists):
                    scalar = row[6] not in ("object", "array")
                    if wanted is not None and scalar and row[2] not in wanted:
                        continue
                    if shape is not None and (row[6] == "array" or not shape.fullmatch(row[4].removesuffix("." + row[2]) if scalar else row[4])):
                        continue
                    at.append(i)
                    out.append(row)
                    held += 200 + 2 * len(row[4]) + 2 * len(row[0])
                    if len(out) >= rows_per_batch or held >= BATCH_BYTES:
                        yield flush()
                        at, out, held = [], [], 0
            if out:
                yield flush()

    return source.mapInArrow(run, schema)


def unreadable(df: DataFrame, text: str, name: str = "unreadable") -> DataFrame:
    """``df`` with whether its text is neither null nor JSON of an object or array, so that nothing is dropped unseen."""

    @F.pandas_udf("boolean")
    def bad(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and not isinstance(read_json(t), (dict, list)))

    return df.withColumn(name, bad(F.col(text)))


def pivot_entities(nodes: DataFrame, keys: list[str], where: Column, members: dict[str, str]) -> DataFrame:
    """Objects that satisfy ``where``, each with scalar children as columns.

    members: label of the child -> name of the column. The join of an object
    with its children is one aggregation on (record, object): an object node
    brings its own row, a scalar its parent's, so a single exchange on that key
    does both the join and the pivot. An object without such children has nulls;
    of a repeated label the last one stays.
    """
    own = F.when(F.col("kind") == "object", F.col("node")).otherwise(F.col("parent"))
    is_object = F.col("kind") == "object"
    keep = (is_object & where) | (~is_object & F.col("label").isin(list(members)) & (F.col("kind") != "array"))
    labelled = nodes.filter(keep).withColumn("__object", own)
    picks = [
        F.max_by(F.when(~is_object & (F.col("label") == label), F.col("scalar")), F.when(~is_object & (F.col("label") == label), F.col("ordinal"))).alias(name)
        for label, name in members.items()
    ]
    facts = [F.max(F.when(is_object, F.col(c))).alias(c) for c in ("parent", "label", "ordinal", "trail", "place")]
    return (
        labelled.groupBy(*keys, "__object")
        .agg(*facts, *picks)
        .filter(F.col("trail").isNotNull())
        .withColumnRenamed("__object", "node")
    )
