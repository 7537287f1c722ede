"""Reading and writing: explicit schemas, tables, query results, CSV, literal frames and period grids."""
