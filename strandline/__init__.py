"""Ordered numeric tables on Spark: window statistics with the results users know from pandas.

Every operator is an expression over an explicit order (and optional
partitioning), so Catalyst plans, fuses and distributes it.
"""

__all__ = ["OrderedFrame", "ordered"]


def __getattr__(name: str):
    # Python workers import this package too, and need none of it.
    if name in __all__:
        from strandline import frame

        return getattr(frame, name)
    raise AttributeError(name)
