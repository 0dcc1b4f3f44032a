"""Binding of the engine to the synthetic driver tables: views, registered queries and their SQL counterparts."""
