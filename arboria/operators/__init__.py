"""Relational operators of the code graph: extraction, links, layout, search, expansion, packing, views, evaluation."""
