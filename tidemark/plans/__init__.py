"""Views, queries and the registry of the driver contract."""
