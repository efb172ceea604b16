"""Jobs put together from sources and operators: sync, fetch, reparse, snapshot and seeding."""
