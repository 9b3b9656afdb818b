"""Streams of mutations into an index, and ordered application of replicated ones."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.segments import IndexWriter


def start_ingest(stream: DataFrame, writer: IndexWriter, checkpoint: str, refresh: bool = True, **trigger) -> StreamingQuery:
    """Each micro-batch is logged under its number, then published; a batch that is run again is logged once."""

    def write(batch: DataFrame, number: int) -> None:
        writer.put(batch, f"s{number}")
        if refresh:
            writer.refresh()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


RECORD = "shard long, epoch long, operation_id string, sequence long, payload string"
OUTCOME = f"{RECORD}, outcome string"


def payload_of(document: dict) -> str:
    """A document in one canonical text."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"))


@dataclass
class OrderedReplica:
    """Applies a shard's records in sequence; a pure fold, used by the stream and by tests."""

    shard: int
    epoch: int
    applied: int = 0
    operations: dict[str, str] = field(default_factory=dict)
    #: Operations that are remembered, the newest; the state of a stream stays bounded. An older one's repeat is a stale sequence.
    most_operations: int = 100_000

    def apply(self, shard: int, epoch: int, operation_id: str, sequence: int, payload: str) -> str:
        """``applied``, ``duplicate``, or why the record is refused."""
        if shard != self.shard:
            return "wrong_shard"
        if epoch != self.epoch:
            return "wrong_epoch"
        if not operation_id:
            return "conflicting_operation"
        digest = hashlib.sha256(f"{sequence}\x00{payload}".encode()).hexdigest()
        known = self.operations.get(operation_id)
        if known is not None:
            return "duplicate" if known == digest else "conflicting_operation"
        if sequence <= self.applied:
            return "stale_sequence"
        if sequence != self.applied + 1:
            return "sequence_gap"
        self.applied = sequence
        self.operations[operation_id] = digest
        if len(self.operations) > self.most_operations:
            del self.operations[next(iter(self.operations))]
        return "applied"


def applied_records(records: Iterable[tuple], replica: OrderedReplica) -> list[str]:
    return [replica.apply(*r) for r in records]


def ordered_apply(stream: DataFrame, epoch: int) -> DataFrame:
    """The outcome of each record of a stream (``RECORD``), with state for each shard.

    Within a micro-batch a shard's records are taken by sequence. State is the last sequence and the digest of each
    operation.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        replica = OrderedReplica(int(key[0]), epoch)
        if state.exists:
            applied, operations = state.get
            replica.applied, replica.operations = int(applied), json.loads(operations)
        for part in parts:
            rows = part.sort_values("sequence", kind="stable")
            rows["outcome"] = [replica.apply(int(r.shard), int(r.epoch), r.operation_id, int(r.sequence), r.payload) for r in rows.itertuples()]
            yield rows
        state.update((replica.applied, json.dumps(replica.operations)))

    return stream.groupBy("shard").applyInPandasWithState(run, OUTCOME, "applied long, operations string", "append", "NoTimeout")
