"""Reading and writing: directories, catalog tables, the lineage log, discovery."""
