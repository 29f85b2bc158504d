"""taxomatch: assign rows of a product table to the best path of a category
taxonomy, written as Spark DataFrame jobs.

Sub-packages
    functions  Column -> Column text and vector functions
    sources    readers and writers (CSV, word vectors, answers, vector collections)
    operators  row keys, documents, k-NN / MMR search, votes, embeddings, word jobs
    plans      the composite classification jobs and the query catalogue
    streaming  incremental classification with Structured Streaming
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions of this package that run in Python workers (Arrow kernels,
    pandas UDFs) are pickled with their code, so executors do not need the
    package installed or on their path."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
