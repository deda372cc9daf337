"""A stream of frames by stream id: the first frame names the schema's hash, later ones may leave it out.

State a stream: the pinned hash. A frame without a hash before any is ``AwaitingHash``; one that contradicts the pinned
hash is ``HashMismatch`` and changes nothing. Frames of a batch are taken in the order of ``seq``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from adtflow.functions import wire

OUT = "stream_id string, seq long, body binary, schema_hash string, error string"


def judge(rows: list[tuple[int, bytes]], pinned: int | None) -> tuple[list[tuple], int | None]:
    """((seq, body, hash, error) of each frame in order, the hash pinned after)."""
    out = []
    for seq, data in sorted(rows, key=lambda r: r[0]):
        found, code = wire.code_of(wire.frame_decode, data)
        if code:
            out.append((seq, None, None, code))
            continue
        body, packed, own = found
        if pinned is None and own is None:
            out.append((seq, None, None, "AwaitingHash"))
            continue
        pinned = own if pinned is None else pinned
        if own is not None and own != pinned:
            out.append((seq, None, f"0x{own:016x}", "HashMismatch"))
            continue
        plain, code = wire.code_of(wire.unpack, body) if packed else (body, None)
        out.append((seq, plain, f"0x{pinned:016x}", code))
    return out, pinned


def negotiate(frames: DataFrame) -> DataFrame:
    """``frames`` (a stream with stream_id, seq, bytes) as OUT: bodies unpacked, each with its stream's hash or an error."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pinned = int(state.get[0], 16) if state.exists else None
        rows = [(int(s), bytes(b)) for df in batches for s, b in zip(df["seq"], df["bytes"], strict=True)]
        out, pinned = judge(rows, pinned)
        if pinned is not None:
            state.update((f"0x{pinned:016x}",))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["stream_id", "seq", "body", "schema_hash", "error"])

    return frames.select("stream_id", "seq", "bytes").groupBy("stream_id").applyInPandasWithState(step, OUT, "pinned string", "append", GroupStateTimeout.NoTimeout)


def split_dead_letters(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    return out.where(F.col("error").isNull()), out.where(F.col("error").isNotNull())
