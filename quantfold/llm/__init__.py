"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the folder is present. Functions that run in tasks are sent by
value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
