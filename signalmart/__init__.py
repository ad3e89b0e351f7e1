"""signalmart: technology-signal intelligence as Spark DataFrame and Structured Streaming jobs.

Modules:
  dims, schemas      fixed vocabularies and the data model
  functions/         row-local Column expressions (text, urls, scalars)
  operators/         DataFrame -> DataFrame operators (filters, joins, aggs, top-k, reshape, standards, enrich)
  sources/           readers and writers (feeds XML, pages, state tables, sinks, fixture views)
  plans/             composed jobs: the monthly run, the query API, the registered queries and their SQL oracles
  streaming/         the incremental run as Structured Streaming
"""
