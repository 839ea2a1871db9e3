"""textloom: Spark-native operators for preparing, sampling, comparing and
evaluating free-text report data.

Row-local work is expressed as ``Column -> Column`` functions
(``textloom.functions``); set-level work as ``DataFrame -> DataFrame``
operators (``textloom.operators``) usable with ``df.transform``.
"""

__version__ = "0.1.0"
