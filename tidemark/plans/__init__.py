"""The stages end to end: collect, features, train, evaluate, report."""
