"""threadlens — mine user-created workarounds from issue discussions with Spark.

Every stage is a DataFrame transformation: text normalisation and regex cue
detection are native column expressions, thread assembly / sampling / label
upserts are joins, windows and aggregates, and the detector is a Spark ML
pipeline. Nothing passes whole through the driver.
"""

from threadlens.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
