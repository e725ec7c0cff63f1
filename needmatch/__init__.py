"""needmatch: set-at-a-time context routing, event log and access analytics on Spark."""
