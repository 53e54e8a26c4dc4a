"""Part of the episode and event-rate library."""
