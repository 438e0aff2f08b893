"""DataFrame -> DataFrame operators, keyed by ``capture_id`` and ``line_no``."""
