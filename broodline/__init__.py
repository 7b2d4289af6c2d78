"""broodline: mark-recapture and breeding-record analytics on Spark DataFrames.

Sub-packages:
  functions/  NA-aware Column helpers and the fixed cleaning rules
  sources/    table readers, adapter views, R-compatible CSV readers and sinks
  operators/  the domain operators (pairs, captures, histories, breeding, fledge, overview)
  plans/      named end-to-end queries over the driver tables and their SQL oracles
  streaming/  intentionally empty: the reference has no streaming code
"""

from broodline.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
