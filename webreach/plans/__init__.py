"""Registered queries. Importing this package registers all of them."""

from webreach.plans import basic, io_queries, site_queries, stream_queries  # noqa: F401
