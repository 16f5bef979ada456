"""Training-data operators over document and conversation tables.

Nothing outside this subpackage imports it; the queries of its operators are in
``cuelattice.llm.queries``.
"""
