"""quillsieve: choose small row sets from text corpora and measure what was chosen, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks carry the functions they use, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
