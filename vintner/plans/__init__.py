"""Plans: the feature task over the driver tables, the end-to-end flow and the
registered queries with their SQL oracles."""
