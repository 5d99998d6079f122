"""Tickets, typed or as exporters wrote them, as flat tables (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.operators.live import live_rows
from morphloom.operators.shred import pivot_entities, read_json, shred, write_json

#: Members that make an object with an "id" a ticket; a wrapper's own header has none of them.
TICKET_MEMBERS = frozenset({"pair", "type", "domain", "status", "target", "impact", "hypotheses", "presentation_options"})
#: Members whose strings may be JSON text.
EMBEDDED = ("hypotheses", "presentation_options", "impact", "edits", "params")
#: Members that are lists, single objects or objects by identifier, and what tells a single object.
COLLECTIONS = {
    "hypotheses": ("id", "mechanism", "description", "edits", "counterfactuals", "discriminates", "metrics", "source", "unverified", "verdict"),
    "presentation_options": ("id", "question_id", "kind", "text", "discriminates"),
    "edits": ("kind", "params"),
}
OPTION_TRAIL, IMPACT_TRAIL = r"^\.presentation_options\[\]$", r"^\.impact$"
EDIT_TRAIL = r"^\.hypotheses\[\]\.edits\[\](\.params\.edits\[\])*$"


def tickets_of(payload: str | None) -> Iterator[tuple[str, dict]]:
    """The tickets in a payload, however wrapped: alone, in lists, in members of wrappers, or as JSON text in JSON text."""
    stack = [read_json(payload)]
    while stack:
        item = stack.pop()
        if isinstance(item, str) and item[:1] in ("{", "["):
            item = read_json(item)
        if isinstance(item, list):
            stack.extend(reversed(item))
        elif isinstance(item, dict):
            if isinstance(item.get("id"), (str, int)) and TICKET_MEMBERS & item.keys():
                yield str(item["id"]), item
            else:
                stack.extend(reversed(list(item.values())))


def unpack_payloads(raw: DataFrame) -> DataFrame:
    """raw_tickets -> (ticket_id, received_at, raw_id, seq, body): one row for each ticket in each readable payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, seqs, bodies = [], [], [], []
            for i, text in enumerate(batch.column(2)):
                for seq, (name, body) in enumerate(tickets_of(text.as_py()), 1):
                    at.append(i)
                    ids.append(name)
                    seqs.append(seq)
                    bodies.append(write_json({k: body.get(k) for k in ("hypotheses", "presentation_options", "impact")}))
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), batch.column(0).take(take), batch.column(1).take(take), pa.array(seqs, pa.int64()), pa.array(bodies, pa.string())],
                names=["ticket_id", "received_at", "raw_id", "seq", "body"],
            )

    source = raw.select(F.col("received_at").cast("timestamp_ntz").alias("received_at"), F.col("raw_id").cast("bigint").alias("raw_id"), "payload")
    return source.mapInArrow(run, "ticket_id string, received_at timestamp_ntz, raw_id bigint, seq bigint, body string")


def ticket_bodies(tickets: DataFrame, raw: DataFrame) -> DataFrame:
    """(ticket_id, body): the live version of each ticket of either table, as JSON text.

    In ``tickets`` the latest updated_at; in ``raw`` the latest received_at
    among readable payloads that hold the ticket (ties: the greatest raw_id,
    then the last in the payload). Tickets without id are left out.
    """
    typed = live_rows(tickets.select("id", "updated_at", "hypotheses", "presentation_options", "impact").filter(F.col("id").isNotNull()), "id", "updated_at")
    typed = typed.select(F.col("id").alias("ticket_id"), F.to_json(F.struct("hypotheses", "presentation_options", "impact")).alias("body"))
    loose = live_rows(unpack_payloads(raw), "ticket_id", "received_at").select("ticket_id", "body")
    return typed.unionByName(loose)


def ticket_nodes(tickets: DataFrame, raw: DataFrame) -> DataFrame:
    """The adjacency table of the live tickets' edits, options and impacts, with their scalars."""
    return shred(ticket_bodies(tickets, raw), ["ticket_id"], "body", EMBEDDED, COLLECTIONS, labels=("kind", "id", "score"), objects=f"{EDIT_TRAIL[1:-1]}|{OPTION_TRAIL[1:-1]}|{IMPACT_TRAIL[1:-1]}")


def plain_digits(column: str) -> Column:
    """The number in a text column, however written, in plain digits; null if it holds none."""
    number = F.expr(f"try_cast(trim({column}) as decimal(38, 6))")
    whole = number.cast("decimal(38, 0)")
    return F.when(number == whole, whole.cast("string")).otherwise(F.regexp_replace(number.cast("string"), r"0+$", ""))


def ticket_entities(tickets: DataFrame, raw: DataFrame) -> DataFrame:
    """(ticket_id, node, hyp_no, path, value): edits, options and impacts of the live tickets.

    Edits inside another edit's params.edits have the outer path, ``.`` and
    their position; positions count null members. Objects without value are left
    out; their inner edits stay.
    """
    nodes = ticket_nodes(tickets, raw)
    trail = F.col("trail")
    is_edit, is_option, is_impact = trail.rlike(EDIT_TRAIL), trail == ".presentation_options[]", trail == ".impact"
    flat = pivot_entities(nodes, ["ticket_id"], is_edit | is_option | is_impact, {"kind": "kind", "id": "id", "score": "score"})
    first = F.substring_index("place", ".", 1)
    return (
        flat.select(
            "ticket_id",
            F.when(is_edit, "edit").when(is_option, "option").otherwise("impact").alias("node"),
            F.when(is_edit, first.cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("hyp_no"),
            F.when(is_edit, F.expr("substring(place, length(substring_index(place, '.', 1)) + 2)")).when(is_option, F.col("place")).otherwise("0").alias("path"),
            F.when(is_edit, F.col("kind")).when(is_option, F.col("id")).otherwise(plain_digits("score")).alias("value"),
        )
        .filter(F.col("value").isNotNull())
    )
