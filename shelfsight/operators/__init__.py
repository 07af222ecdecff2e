"""DataFrame -> DataFrame operators: ingest, cleaning, warehouse, KPIs, scoring."""
