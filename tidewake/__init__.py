"""Change-impact analytics on DataFrames: dependency graphs, impact scores, lexical
and history signals, budgeted selection, retrieval evaluation."""
