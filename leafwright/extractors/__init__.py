"""Field extractors of page forms: projections of a page's lines and controls."""
