"""Named queries and the SQL each must agree with."""
