"""Training-data operators: dedup, mixing, WARC, quality, fingerprints, language, packing, token files, LM scores.

Nothing outside this sub-package imports it, except ``__spark_entry__.py`` (guarded) and
``corpus_pipeline.py``.  Each module holds one operator with its own general interface;
``queries.py`` derives the registered ``opN_*`` result columns from them.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
