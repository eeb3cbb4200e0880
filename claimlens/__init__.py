"""Analytics over masked-token marginals, declared as DataFrame plans.

functions: Column builders; operators: DataFrame -> DataFrame; sources: scans and sinks; streaming:
the same scoring over streams; plans: registered queries.
"""

__version__ = "0.1.0"
