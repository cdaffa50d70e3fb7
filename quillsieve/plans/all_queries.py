"""Importing this module registers every query."""

from quillsieve.plans import text_queries  # noqa: F401
from quillsieve.plans import select_queries  # noqa: F401
from quillsieve.plans import greedy_queries  # noqa: F401
from quillsieve.plans import metric_queries  # noqa: F401
from quillsieve.plans import layer_queries  # noqa: F401
from quillsieve.plans import result_queries  # noqa: F401
from quillsieve.plans import source_queries  # noqa: F401
