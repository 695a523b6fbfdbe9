"""Named queries over the fixture tables, each with the SQL that checks it."""
