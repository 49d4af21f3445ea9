"""Page and thread corpora as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from threadloom.page_profile import ARTICLE, FORUM, PageProfile  # noqa: E402
from threadloom.session import configure, workdir, written  # noqa: E402

__all__ = ["ARTICLE", "FORUM", "PageProfile", "configure", "workdir", "written"]
