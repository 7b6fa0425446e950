"""docgrain: analytics over OCR-ed business documents, written as Spark jobs."""

import sys

from pyspark import cloudpickle

from .session import shared_dir, tune

# Python functions travel to the executors with the job, so the package need not be installed
# there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["shared_dir", "tune"]
