"""Forensic-artifact analytics over raw media images, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Code that runs in Python workers travels with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
