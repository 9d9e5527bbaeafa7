"""tabulo: table profiling, cleaning and auto-analysis as Spark DataFrame jobs.

functions/  native Column expressions (numbers, dates, text, names)
operators/  DataFrame operators (frequency table, profile, cleaning, dictionaries,
            chart aggregates, statistics, series, confidence)
plans/      question planning, dispatch, report tables, registered queries
sources/    file and HTML-page sources, sinks
streaming/  the cleaning projection on Structured Streaming
"""

__version__ = "0.1.0"
