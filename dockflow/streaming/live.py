"""The live job: records in, gated batches published."""

import hashlib

from dockflow.schemas import BATCH_TIMEOUT_SECONDS
from dockflow.session import checkpoint_root
from dockflow.sources.records import envelopes_of, event_rules, flat_records
from dockflow.streaming.gate import Gate, gate_input, ticks
from dockflow.streaming.publish import publisher, refresher


def start_live(source, metadata, root, mode="live", timeout_seconds=BATCH_TIMEOUT_SECONDS, trigger=None, checkpoints=None):
    """Start the job on a stream of lines or envelopes; its state lies under the cluster's shared checkpoint folder, by served root and mode.

    Every trigger lists the metadata files anew before it reads its records, so a version may land together with the first records
    that name it. Batches time out at the next trigger, with or without new records; a draining run (`availableNow`) ends with its
    input instead.
    """
    spark = source.sparkSession
    trigger = trigger or {"processingTime": "10 seconds"}
    if "availableNow" not in trigger and "once" not in trigger:
        source = source.unionByName(ticks(spark, source.schema))
    job = hashlib.sha256(f"{root}\n{mode}".encode()).hexdigest()[:16]
    folder = f"{checkpoint_root(spark, checkpoints)}/live-gate-{job}"
    step = gated(metadata, Gate(f"{folder}-state", mode, timeout_seconds), publisher(root, metadata))
    writer = source.writeStream.outputMode("append").foreachBatch(step)
    return writer.option("checkpointLocation", folder).trigger(**trigger).start()


def gated(metadata, gate, then):
    """A `foreachBatch` function: a trigger's lines or envelopes through the gate, and its output to `then`."""
    refresh = refresher(metadata)

    def run(batch, number):
        refresh()
        records = gate_input(flat_records(envelopes_of(batch)), event_rules(), metadata)
        then(gate(records, number), number)

    return run
