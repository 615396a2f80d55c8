"""Training-data operators: ten operators over documents, embeddings and pages.

Nothing else in the library imports this package; ``queries.py`` maps the
registered names to the operators.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
