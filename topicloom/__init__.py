"""topicloom: support-ticket topics and help-article coverage as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
