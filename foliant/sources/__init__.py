"""Where records come from and go to: remote pages, landed batches, tables and snapshots."""
