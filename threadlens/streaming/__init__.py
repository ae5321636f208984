"""Structured Streaming entry points.

The collection stage lands API responses continuously; the row-level
operators (I1/I2 flattening, T1/T8 text and cue expressions) are pure column
expressions and run unchanged on a ``readStream`` source, and the detector
(M12) scores every micro-batch with ``foreachBatch``. Checkpoints go to the
shared folder named by ``spark.checkpoint.dir``.
"""

from threadlens.streaming.streams import (
    collect_stream,
    cue_stream,
    issue_stream,
    latest_issues,
    score_stream,
    stream_checkpoint,
)

__all__ = ["collect_stream", "latest_issues", "issue_stream", "cue_stream", "score_stream", "stream_checkpoint"]
