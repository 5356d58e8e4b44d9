"""The library bound to the given tables: views, registered queries and their SQL twins."""
