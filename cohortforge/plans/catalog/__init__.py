"""Query catalog, one module per SURVEY section. Importing a module registers its queries."""
