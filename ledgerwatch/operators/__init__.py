"""DataFrame -> DataFrame operators, grouped by the stage that uses them."""
