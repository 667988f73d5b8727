"""All registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from pyspark import cloudpickle

from lectern.functions import model_output
from workload import answers, links, operations, texts, timeline

# Python functions of these modules travel with the tasks, so workers need no
# copy of the packages.
for _module in (model_output, answers):
    cloudpickle.register_pickle_by_value(_module)

ALL: dict = {
    **timeline.QUERIES,
    **texts.QUERIES,
    **links.QUERIES,
    **answers.QUERIES,
    **operations.QUERIES,
}
