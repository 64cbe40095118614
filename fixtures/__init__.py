"""Market tables derived from the driver's tables, and the SQL that checks the operators."""
