"""Multi-table jobs: loads, chains, snapshots, verification."""
