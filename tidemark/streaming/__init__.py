"""Scenarios of steps, run as a batch loop or by a stream of step manifests."""
