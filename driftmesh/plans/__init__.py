"""The warp and its derivatives, and the query catalogue."""
