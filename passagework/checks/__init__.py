"""Every operator as a query over the given tables, with an equal query in SQL."""
