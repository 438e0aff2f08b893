"""Input views, the query catalogue and the end-to-end job."""
