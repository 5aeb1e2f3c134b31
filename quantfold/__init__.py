"""quantfold — financial panels, macro series and report text as Spark jobs.

Every job is a function from DataFrames to a DataFrame. Sub-packages:

* ``functions``  column expressions (null/ANSI helpers, text, dates, URLs)
* ``sources``    readers, sinks and the domain views over raw tables
* ``operators``  table operators (panel, time series, text, links,
                 portfolio, forecasting, models)
* ``plans``      composed jobs and the query registry
"""

__version__ = "0.1.0"
