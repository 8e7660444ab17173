"""Named queries over the driver tables, each with the SQL that gives the same rows."""
