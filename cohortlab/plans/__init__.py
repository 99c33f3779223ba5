"""Views over the shared tables and the registered queries with their SQL."""
