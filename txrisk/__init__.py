"""Spark-native pending-transaction risk analytics.

Layout:
  functions/  column expressions (logs, hash bins, labels, seeded uniforms, losses)
  sources/    readers and writers (raw events, score/metric tables, manifest)
  operators/  DataFrame operators (global-order scans, features, labels, metrics, ...)
  plans/      end-to-end jobs (dataset build, evaluation) composed from operators
  streaming/  Structured Streaming versions of the causal features and outcomes
"""

from txrisk.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
