"""quarry — find where grouped keywords occur in a large corpus, on Spark.

Layout:
  sources/    dictionary, file listing, corpus views, container explosion
  functions/  Column-level text helpers (fold, boundary regex, HTML, paths)
  operators/  matching, per-file facts, reports
  plans/      sinks (manifests, tables, copy plans) and end-to-end scan jobs
  streaming/  incremental batch and Structured Streaming scans
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task closures reference functions of this package; pickle them by value so
# executors need no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from quarry.session import build_session, checkpoint_dir  # noqa: F401
from quarry.sources.dictionary import KeywordDictionary, TEST_DICTIONARY  # noqa: F401

__all__ = ["build_session", "checkpoint_dir", "KeywordDictionary", "TEST_DICTIONARY"]
