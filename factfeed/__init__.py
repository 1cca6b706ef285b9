"""factfeed: claim-level factuality feedback as Spark table jobs."""
