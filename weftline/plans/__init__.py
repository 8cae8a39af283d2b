"""Named queries over a directory of tables, each with the SQL it is checked against."""
