"""logfold: Spark-native log incident analytics.

Entry points: ``logfold.sources`` (files, tables), ``logfold.operators``
(parse, context, aggregates, ranking, snippets, evidence, report, assist),
``logfold.plans.analysis`` (end-to-end plans and the JSON sink),
``logfold.streaming`` (file-arrival reports) and ``python -m logfold``.
"""

__version__ = "0.1.0"
