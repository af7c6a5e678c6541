"""Business-control reports as Spark DataFrames.

``functions``  Column expressions (ratios, text, classification)
``operators``  periods, filters, joins, aggregates, hierarchy, policy, maintenance
``sources``    table schemas, loaders, JSON requests, profiling, sinks
``plans``      one function per report, each returning named DataFrames
``checks``     the registered queries with their SQL counterparts
"""
