"""Analytics over versioned file catalogs and content-addressed chunk stores, on Spark."""
