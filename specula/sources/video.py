"""Frames from video files, through a decoder that a task loads.

A decoder is a callable without arguments that returns a function from a file's bytes and the wanted frame numbers (None for
all) to an iterator of (frame_id, frame_count, pixels), pixels an array of bytes, height x width x 3. It may seek. ``raw``
decodes the container that the tests use; ``adapters`` has a decoder of common formats, any other is a plug-in.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specula.operators.features import FRAMES

MAGIC = b"SPVID1"


def encode_raw(frames: np.ndarray) -> bytes:
    """n x height x width x 3 bytes as one uncompressed file."""
    return MAGIC + struct.pack("<IIII", *frames.shape) + frames.tobytes()


def frame_count(content: bytes) -> int:
    """0 for what can't be opened."""
    return struct.unpack_from("<I", content, len(MAGIC))[0] if content[: len(MAGIC)] == MAGIC else 0


def raw():
    def decode(content: bytes, wanted):
        n = frame_count(content)
        if not n:
            return
        _, h, w, c = struct.unpack_from("<IIII", content, len(MAGIC))
        start, size = len(MAGIC) + 16, h * w * c
        for k in range(n) if wanted is None else sorted(set(wanted)):
            yield k, n, np.frombuffer(content, np.uint8, size, start + k * size).reshape(h, w, c)

    return decode


def sample_indices(n: int, most: int | None) -> list[int]:
    if n <= 0:
        return []
    if most is None or n <= most:
        return list(range(n))
    return np.linspace(0, n - 1, int(most)).astype(int).tolist()


#: Bytes of pixels in a batch that leaves the decoder; a larger frame is one of its own.
BATCH = 8 << 20


def read_frames(spark: SparkSession, path: str, max_frames: int | None = None, decoder=raw, count=None) -> DataFrame:
    """The frames of all files at path, of each at most max_frames, evenly spaced; unreadable files have none.

    Sampling is decided before decoding, so a decoder that seeks reads no other frames. A file is one task's; frames leave
    it by and by. A decoder with an attribute ``by_path`` gets the file's path instead of its bytes, so that files of any
    size do; its attribute ``count`` (or the parameter) tells the number of frames from the same.
    """
    count = count or getattr(decoder, "count", frame_count)
    by_path = getattr(decoder, "by_path", False)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path" if by_path else "content").alias("content"))
    files = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("video_id"), "content")
    names, kinds = [f.split()[0] for f in FRAMES.split(", ")], [pa.string(), *[pa.int32()] * 5, pa.binary()]

    def run(batches):
        decode = decoder()
        for batch in batches:
            for video, content in zip(batch.column("video_id").to_pylist(), batch.column("content")):
                data = content.as_py()
                wanted = None if max_frames is None else sample_indices(count(data), max_frames)
                held, size = [], 0
                for k, n, pixels in decode(data, wanted):
                    held.append((video, k, n, *pixels.shape, pixels.tobytes()))
                    size += pixels.nbytes
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), kinds)], names)

    return files.mapInArrow(run, FRAMES)
