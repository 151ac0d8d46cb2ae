"""The library's queries on the benchmark tables, with SQL to check them."""
