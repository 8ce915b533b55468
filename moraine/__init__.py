"""Archives of packed, compressed and encrypted files as Spark tables, and operators over them."""
