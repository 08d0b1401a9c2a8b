"""ledgerloom: messy monthly reports into a clean star schema, and data preparation at scale, on Spark."""
