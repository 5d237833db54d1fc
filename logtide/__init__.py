"""logtide: access-log analytics as Spark DataFrame jobs.

Sub-packages: ``sources`` (ingest), ``sinks`` (writers), ``functions``
(column expressions and fixed values), ``operators`` (aggregates, detectors,
chart tables, profile), ``plans`` (registered queries, oracle SQL, report
job) and ``streaming`` (Structured Streaming versions).
"""

__version__ = "0.1.0"


def _pickle_functions_by_value() -> None:
    """Serialise this package's functions by value for Python workers, so
    pandas UDFs run on executors that do not have the package installed."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - optional convenience
        pass


_pickle_functions_by_value()
