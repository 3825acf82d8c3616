"""Named checks: each pairs a call of the library on the given tables with the SQL that states its result."""
