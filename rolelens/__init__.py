"""Role-scoped analytics over one shared table, as ordinary Spark plans."""
