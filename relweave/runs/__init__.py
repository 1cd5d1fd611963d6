"""Analytics over evaluation runs: roll-ups, differences, snapshots, histories and what to run next."""
