"""Qualification rosters on Spark: current roster, expiry and issue lists, snapshots, state and run history."""
