"""Compositions: the warehouse build, the batch run and the query registry."""
