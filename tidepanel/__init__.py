"""tidepanel: panel time-series operators on Spark DataFrames.

Operators take and return DataFrames over the long panel contract
``(series STRING, ts DATE, value DOUBLE)``; see :mod:`tidepanel.operators.panel`. They
are lazy, but for those that need several passes and write tables to the shared folder
when called: ``exact_quantile`` (and medians of bins and pivots), ``adf_screen``,
``ensure_stationary``, ``mixed_freq_panel``, ``pca_variance``, ``fit_dfm``,
``evaluate_models``, ``backward_select``, ``apply_vintage``, ``news`` and the sinks.
"""

__version__ = "0.1.0"


def _travel_by_value() -> None:
    """Functions of this package reach the Python workers by value, so executors
    need no copy of it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_travel_by_value()
