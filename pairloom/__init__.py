"""Pairwise-judgement analytics and training-data operators for PySpark.

Everything is a function from DataFrames to DataFrames.  ``operators`` holds
the relational work, ``functions`` the column expressions, ``sources`` the
readers and sinks, ``plans`` the multi-step jobs (solver, adaptive loop),
``streaming`` the structured-streaming forms.  The subpackage ``llm`` builds on
these and is imported by none of them.
"""

import sys

from pyspark import cloudpickle

from pairloom.session import build_session, scratch_dir

# The executors' Python workers need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_dir"]
