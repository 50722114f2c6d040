"""Keep a large collection of versioned JSON entities current, and export it, with Spark."""
